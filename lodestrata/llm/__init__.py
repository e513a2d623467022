"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` registers the thin ``opN_*`` queries and ``oracles`` their SQL.
"""
