"""Operators: functions from DataFrames to a tidy DataFrame."""
