"""Operators for building language-model training data, on Spark DataFrames.

Nothing outside this package imports it; ``queries`` holds the registered queries.
"""
