"""Operators of a training-data pipeline over very large document tables.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and returns DataFrames; the thin ``opN_*`` queries in
``queries.py`` derive the digest columns from what the operators return.
"""
