"""Operators over the relations of a corpus; each takes and returns DataFrames."""
