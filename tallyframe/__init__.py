"""Inventory analytics over stock statements, and text operators for training data, as Spark jobs."""
