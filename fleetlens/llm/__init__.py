"""Operators of a training-data pipeline: deduplication, decontamination, tokenising, scoring.

Each module holds one operator with a general interface (DataFrames in, DataFrames out) and
states in its docstring what nulls, empty and long texts, ties and repeated rows give.
``catalog`` registers one query per operator.  Nothing outside this subpackage imports it.
"""
