"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Each operator has its own general
interface (DataFrame in, DataFrame out); `queries` holds the registered queries.
"""
