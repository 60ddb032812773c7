"""Inventory operators: functions from DataFrames to lazy DataFrames."""
