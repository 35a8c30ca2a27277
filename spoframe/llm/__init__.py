"""Operators for preparing large text corpora (one module per operator).

Nothing else in the library imports this subpackage.  The registered queries
and their DuckDB SQL are in :mod:`spoframe.llm.queries`.
"""
