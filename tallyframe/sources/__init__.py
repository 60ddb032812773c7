"""Where statement grids, catalogs and histories come from, and where results go."""
