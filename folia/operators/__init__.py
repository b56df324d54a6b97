"""Operators on layout tables: each takes and returns DataFrames."""
