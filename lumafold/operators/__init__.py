"""Operators: functions from DataFrames to DataFrames, without actions unless they say so."""
