"""Operators for preparing text corpora: DataFrame in, DataFrame out.

Nothing outside this subpackage imports it.  ``queries`` holds the registered queries and their SQL.
"""
