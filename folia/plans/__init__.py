"""Whole conversions, as compositions of operators."""
