"""Operators on DataFrames beyond single expressions: time series, graphs."""
