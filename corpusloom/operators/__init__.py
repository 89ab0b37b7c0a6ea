"""Operators over DataFrames of records: filters, statistics, merges, search, rules."""
