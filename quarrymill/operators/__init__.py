"""Operators from DataFrames to DataFrames: retrieval, validation, generation, metrics, reports."""
