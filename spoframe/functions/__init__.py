"""Scalar column functions: predicate name forms."""

from spoframe.functions.names import (
    aggregate_key_name,
    catalogue_name,
    column_map,
    metastore_name,
    name_variants,
    strip_enclosing_brackets,
    table_name,
    valid_column_name,
)

__all__ = [
    "aggregate_key_name",
    "catalogue_name",
    "column_map",
    "metastore_name",
    "name_variants",
    "strip_enclosing_brackets",
    "table_name",
    "valid_column_name",
]
