"""Operators for preparing large text, page and vector corpora for model training.

Nothing outside this folder imports it.  Every operator takes DataFrames plus column
names, reads only the columns it is told to read, and returns only the columns its
docstring lists, so extra input columns, whatever their names, never clash.
"""
