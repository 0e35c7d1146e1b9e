"""Operators of a training-data pipeline; nothing outside this subpackage imports it.

Every operator takes DataFrames and returns a DataFrame.  The modules whose names
start with ``op`` hold one operator each; ``entries`` holds the thin queries.
"""
