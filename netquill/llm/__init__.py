"""Operators for preparing training data, built on Spark DataFrames.

Nothing else in the library imports this subpackage.
"""
