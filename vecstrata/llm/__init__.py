"""Operators for large training corpora.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames, reads whole tables and whole texts, and keeps every row.
"""
