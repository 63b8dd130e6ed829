"""Operators over DataFrames that SQL statements and callers share."""
