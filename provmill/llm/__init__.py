"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
with arbitrary extra columns and names the columns it reads as parameters, so
a clash between a caller's columns and an operator's results is decided by the
caller.  Null texts count as empty texts unless an operator says otherwise.
"""
