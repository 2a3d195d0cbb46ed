"""Readers that land files, symbols, references and history as DataFrames."""
