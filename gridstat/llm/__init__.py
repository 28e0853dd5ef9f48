"""Operators of a training-data pipeline: thirteen text operators and their queries.

Nothing else in the library imports this subpackage.
"""
