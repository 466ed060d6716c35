"""Operators for preparing large text corpora: deduplication, search, scoring, mixing and packing.

Every operator is a function from DataFrames to DataFrames. Nothing outside this package imports it.
"""
