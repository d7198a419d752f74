"""Operators for preparing training corpora: documents, conversations and benchmark items as DataFrames.

Operators take the names of their id and text columns and read no other column, so extra columns, also such with the
names of result columns, do no harm. A null text counts as empty. Ids may be null or repeated.
"""
