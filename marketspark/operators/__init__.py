"""Operators over DataFrames: filters, joins, aggregates, ordered scans, models."""
