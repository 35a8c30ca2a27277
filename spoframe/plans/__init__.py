"""Query plans over the stored layouts: the store and basic-graph-pattern matching."""

from spoframe.plans.match import (
    check_connected,
    close_triangles,
    match,
    match_all,
    order_units,
    reduce_frames,
    shared_scans,
    tagged_union,
    write_all,
)
from spoframe.plans.store import TripleStore, load_store, load_tables, load_text

__all__ = [
    "TripleStore",
    "check_connected",
    "close_triangles",
    "load_store",
    "load_tables",
    "load_text",
    "match",
    "match_all",
    "order_units",
    "reduce_frames",
    "shared_scans",
    "tagged_union",
    "write_all",
]
