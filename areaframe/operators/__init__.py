"""Operators: functions from DataFrames to DataFrames, names as parameters."""
