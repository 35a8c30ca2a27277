"""Sources and sinks: triple text, relational tables, stored layouts."""

from spoframe.sources.layouts import (
    only_predicates,
    predicate_id,
    read_catalogue,
    read_lists,
    read_property_table,
    read_result,
    read_stats,
    read_subject_files,
    read_vp,
    scan_vp,
    subject_files,
    write_catalogue,
    write_lists,
    write_property_table,
    write_result,
    write_result_table,
    write_stats,
    write_subject_files,
    write_vp,
)
from spoframe.sources.tables import predicate, triples_from_tables
from spoframe.sources.text import read_triples, write_lines, write_triples

__all__ = [
    "only_predicates",
    "predicate_id",
    "predicate",
    "read_catalogue",
    "read_lists",
    "read_property_table",
    "read_result",
    "read_stats",
    "read_subject_files",
    "read_triples",
    "read_vp",
    "scan_vp",
    "subject_files",
    "triples_from_tables",
    "write_catalogue",
    "write_lines",
    "write_lists",
    "write_property_table",
    "write_result",
    "write_result_table",
    "write_stats",
    "write_subject_files",
    "write_triples",
    "write_vp",
]
