"""Cartulary: record extraction, page grouping and reconciliation on Spark DataFrames."""
