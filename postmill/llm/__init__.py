"""Operators for large-scale training-data preparation.

Each module holds one operator with a general interface (DataFrame in, DataFrame
out, column names as parameters); ``queries`` registers the thin queries.
"""
