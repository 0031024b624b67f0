"""Operators for large training corpora: deduplication, decontamination, scans, scoring, encoding.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and column names,
keeps only the columns it needs (so extra columns with clashing names do no harm) and returns
one row per input row unless its docstring says otherwise.
"""
