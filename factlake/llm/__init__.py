"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it. The thin ``opN_<name>`` queries and their SQL
are in :mod:`factlake.llm.queries`.
"""
