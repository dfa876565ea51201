"""Operators on hourly series: every function takes and returns DataFrames."""
