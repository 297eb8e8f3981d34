"""Operators on DataFrames; all are lazy and none collects."""
