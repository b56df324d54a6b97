"""Sources: markup, layout dumps, vector graphics, office packages, pictures, fonts and external programs as DataFrames.

Bytes and markup are parsed by Arrow functions, row by row; everything after them is relational.
"""
