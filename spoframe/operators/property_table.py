"""Property table: one row per subject, one column per predicate.

A single-valued predicate becomes a ``string`` column, a multi-valued one an
``array<string>`` column; a subject without the predicate has NULL there.

Build: one shuffle of the triples by subject, then one local aggregate by
subject with a cell for each column.  ``tasks`` is the width of that shuffle
(see :func:`spoframe.session.task_count`), so that a task's rows, which it
sorts, need not grow with the input; ``ranged`` deals subjects by range, as the
stored table is, so that it is written without another shuffle.
Every predicate asked for is a column and every subject a row,
whatever the number of values: which predicates are in the table is the
caller's choice (``predicates=[...]``), never a threshold.  A cell holds all
objects of one subject for one predicate, so predicates with hub subjects are
better left to the partitioned layout, whose rows are split at will.
Building a row costs (columns x rows of that subject); very wide tables should
be built over a ``predicates=[...]`` subset.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoframe.functions.names import column_map
from spoframe.sources.layouts import only_predicates


@dataclass(frozen=True)
class PTColumn:
    p: str  # verbatim predicate
    column: str  # property-table column
    is_list: bool  # multi-valued -> array<string>


def plan_columns(stats: DataFrame, predicates: list[str] | None = None) -> list[PTColumn]:
    """The table's columns (driver side, one row per predicate): all predicates, or those given."""
    chosen = stats if predicates is None else stats.where(F.col("p").isin(list(predicates)))
    rows = chosen.select("p", "is_complex").collect()
    names = column_map([r["p"] for r in rows])
    return [PTColumn(r["p"], names[r["p"]], bool(r["is_complex"])) for r in sorted(rows)]


def columns_from_catalogue(catalogue: DataFrame, table: DataFrame) -> list[PTColumn]:
    """Columns of a stored table: names from the catalogue, list-ness from the schema.

    A list column holds the values, or their number where those are in chunks.
    """
    types = {f.name: f.dataType.typeName() for f in table.schema.fields}
    rows = catalogue.select("p", "column").collect()
    return sorted(
        (PTColumn(r["p"], r["column"], types.get(r["column"]) in ("array", "long")) for r in rows if r["column"] in types),
        key=lambda c: c.p,
    )


def by_subject(rows: DataFrame, tasks: int | None = None, ranged: bool = False) -> DataFrame:
    """Rows dealt by subject into ``tasks`` tasks (default: as the session says)."""
    width = [] if tasks is None else [tasks]
    return rows.repartitionByRange(*width, "s") if ranged else rows.repartition(*width, "s")


def grouped_properties(triples: DataFrame, predicates: list[str], tasks: int | None = None) -> DataFrame:
    """E5: ``(s, m)`` with ``m: map<p, array<o>>`` for the given predicates.

    Duplicate triples stay duplicates inside a list.  List order is the
    order rows arrive in and is not defined.
    """
    per_pair = by_subject(only_predicates(triples, predicates), tasks).groupBy("s", "p").agg(F.collect_list("o").alias("os"))
    return per_pair.groupBy("s").agg(
        F.map_from_entries(F.collect_list(F.struct("p", "os"))).alias("m")
    )


def property_table(
    triples: DataFrame, columns: list[PTColumn], tasks: int | None = None, ranged: bool = False, in_place: bool = False
) -> DataFrame:
    """E6 + B14: the wide table ``(s, <column>...)``.

    ``in_place``: the triples lie by subject (bucketed tables) and are not dealt again.
    A single-valued column of a subject that has more values holds the largest.
    """
    rows = only_predicates(triples, [c.p for c in columns]).select("s", "p", "o")
    of = {c.p: F.when(F.col("p") == F.lit(c.p), F.col("o")) for c in columns}
    # plain names inside: those of columns may hold dots
    cells = [(F.collect_list if c.is_list else F.max)(of[c.p]).alias(f"__c{i}") for i, c in enumerate(columns)]
    shown = [
        (F.when(F.size(f"__c{i}") > 0, F.col(f"__c{i}")) if c.is_list else F.col(f"__c{i}")).alias(c.column)
        for i, c in enumerate(columns)
    ]
    return (rows if in_place else by_subject(rows, tasks, ranged)).groupBy("s").agg(*cells).select("s", *shown)


def properties_array(triples: DataFrame, predicates: list[str], tasks: int | None = None) -> DataFrame:
    """H1: ``(s, props: array<array<string>>)`` ordered like ``predicates``, NULL if absent.

    Every list is whole: a subject's values for the predicates are one row.
    """
    m = F.col("m")
    props = F.array(*[m[F.lit(p)] for p in predicates])
    return grouped_properties(triples, predicates, tasks).select("s", props.alias("props"))
