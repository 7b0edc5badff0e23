"""Training-data operators: search, deduplication, scoring, mixing and packing.

Nothing outside this package imports it.  Every operator is a function from
DataFrames to DataFrames; ``queries`` registers one query per operator.
"""
