"""Operators of a training-data pipeline, each built on Spark DataFrames.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
