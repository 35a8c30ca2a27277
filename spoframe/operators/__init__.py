"""Operators: profile aggregates, property table, pattern scans, joins."""

from spoframe.operators.cycles import triangle_join
from spoframe.operators.joins import natural_join, semijoin, shared_variables
from spoframe.operators.list_store import list_chunks, list_sizes, list_values
from spoframe.operators.patterns import Pattern, Var, as_pattern, scan_pattern, scan_star
from spoframe.operators.profile import (
    catalogue_from_stats,
    distinct_predicates,
    graph_stats,
    lookup_stats,
    multivalued_predicates,
    predicate_catalogue,
    predicate_profile,
    predicate_stats,
    single_valued_predicates,
    with_columns,
)
from spoframe.operators.property_table import (
    PTColumn,
    columns_from_catalogue,
    grouped_properties,
    plan_columns,
    properties_array,
    property_table,
)

__all__ = [
    "PTColumn",
    "Pattern",
    "Var",
    "as_pattern",
    "catalogue_from_stats",
    "columns_from_catalogue",
    "distinct_predicates",
    "graph_stats",
    "grouped_properties",
    "list_chunks",
    "list_sizes",
    "list_values",
    "lookup_stats",
    "multivalued_predicates",
    "natural_join",
    "plan_columns",
    "predicate_catalogue",
    "predicate_profile",
    "predicate_stats",
    "properties_array",
    "property_table",
    "scan_pattern",
    "scan_star",
    "semijoin",
    "shared_variables",
    "single_valued_predicates",
    "triangle_join",
    "with_columns",
]
