"""Scalar functions, usable as columns and, once registered, from SQL."""
