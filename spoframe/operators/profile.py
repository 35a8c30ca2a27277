"""Predicate profile: distinct predicates, multiplicity, statistics, catalogue.

Everything comes from one pass over the triples and two aggregates.  The
first counts rows per ``(p, side, value)``, for the subject and the object of
each row (map-side combined, so a hot subject, a hot object or a block of
duplicate triples shrinks to one row per task before the shuffle); the second
folds those counts per ``p``, again map-side first.  The first shuffle is keyed
on the value too, so one predicate that holds a large share of all rows still
spreads over every reducer; the second moves a row per predicate and task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoframe.functions.names import column_map

# Fixed value: the logarithm base of the cost score.
COST_LOG_BASE = 1.2
#: Ways that the rows of one subject are spread where tasks are asked for.
SUBJECT_SALTS = 64


def distinct_predicates(triples: DataFrame) -> DataFrame:
    """The distinct predicates ``(p)``."""
    return triples.select("p").distinct()


def predicate_catalogue(triples: DataFrame) -> DataFrame:
    """``(p, is_complex)``: 1 where some subject has the predicate more than once (exact duplicates count)."""
    per_subject = triples.groupBy("p", "s").agg(F.count(F.lit(1)).alias("n"))
    return per_subject.groupBy("p").agg((F.max("n") > 1).cast("int").alias("is_complex"))


def multivalued_predicates(triples: DataFrame) -> DataFrame:
    """Predicates some subject has more than once (exact duplicates count)."""
    return predicate_catalogue(triples).where("is_complex = 1").select("p")


def single_valued_predicates(triples: DataFrame) -> DataFrame:
    """all predicates except the multi-valued ones."""
    return predicate_catalogue(triples).where("is_complex = 0").select("p")


def predicate_stats(triples: DataFrame, tasks: int | None = None, in_place: bool = False) -> DataFrame:
    """``(p, size, distinct_subjects, distinct_objects, max_multiplicity, is_complex)``.

    ``size`` counts rows (duplicates included), the distinct counts are exact,
    ``is_complex`` is ``size > distinct_subjects``.  One scan, two exchanges.

    The counts of a task are held in memory before they are shuffled.  With
    ``tasks`` the triples are first dealt into so many, for scans whose tasks are
    large; a hot subject or object is spread over them.  With ``in_place`` the triples
    are a table bucketed by subject: subjects are counted where they lie, in a scan
    of their own, and only the distinct objects of a scan task are shuffled.
    """
    if in_place:
        return _stats_in_place(triples)
    if tasks is not None:
        triples = triples.select("s", "p", "o").repartition(tasks, "s", "o")
    sides = F.array(
        F.struct(F.lit(True).alias("subject"), F.col("s").alias("value")),
        F.struct(F.lit(False).alias("subject"), F.col("o").alias("value")),
    )
    counts = triples.select("p", F.inline(sides)).groupBy("p", "subject", "value").agg(F.count(F.lit(1)).alias("n"))
    of_subject = F.when(F.col("subject"), F.col("n"))
    return (
        counts.groupBy("p")
        .agg(
            F.sum(of_subject).alias("size"),
            F.count(of_subject).alias("distinct_subjects"),
            F.count(F.when(~F.col("subject"), F.lit(1))).alias("distinct_objects"),
            F.max(of_subject).alias("max_multiplicity"),
        )
        .withColumn("is_complex", F.col("size") > F.col("distinct_subjects"))
    )


def _stats_in_place(triples: DataFrame) -> DataFrame:
    """:func:`predicate_stats` of triples that lie by subject."""
    none = F.lit(None).cast("bigint")
    n = F.count(F.lit(1)).alias("n")
    subjects = triples.groupBy("p", "s").agg(n).select("p", "n", none.alias("objects"))
    objects = triples.select("p", "o").distinct().groupBy("p").agg(n).select("p", none.alias("n"), F.col("n").alias("objects"))
    return (
        subjects.unionByName(objects)
        .groupBy("p")
        .agg(
            F.sum("n").alias("size"),
            F.count("n").alias("distinct_subjects"),
            F.sum("objects").alias("distinct_objects"),
            F.max("n").alias("max_multiplicity"),
        )
        .withColumn("is_complex", F.col("size") > F.col("distinct_subjects"))
    )


def graph_stats(triples: DataFrame, stats: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Whole-graph statistics, one row: ``size, distinct_subjects, predicates``.

    ``distinct_subjects`` is exact: subjects are counted after a map-side
    combined ``distinct`` (keyed on ``s``, so a hot subject is one row per
    task), as a scalar subquery Spark runs once.  ``size`` and ``predicates``
    come from the per-predicate statistics when given.  ``tasks``: as for
    :func:`predicate_stats`; the rows of a subject are dealt over ``SUBJECT_SALTS`` of them.
    """
    rows = triples.select("s")
    if tasks is not None:
        salt = F.pmod(F.xxhash64("o"), F.lit(SUBJECT_SALTS)).cast("int").alias("salt")
        rows = triples.select("s", salt).repartition(tasks, "s", "salt").select("s")
    subjects = rows.distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    if stats is None:
        totals = triples.agg(F.count(F.lit(1)).alias("size"), F.count_distinct("p").alias("predicates"))
    else:
        totals = stats.agg(F.sum("size").cast("bigint").alias("size"), F.count(F.lit(1)).alias("predicates"))
    return totals.select("size", subjects.alias("distinct_subjects"), "predicates")


def catalogue_from_stats(stats: DataFrame) -> DataFrame:
    """``(p, is_complex)`` read off the statistics (no second pass over triples)."""
    return stats.select("p", F.col("is_complex").cast("int").alias("is_complex"))


def with_columns(catalogue: DataFrame, predicates: list[str]) -> DataFrame:
    """Attach the property-table column name to catalogue rows.

    ``predicates`` is the (driver-side) list the property table covers; the
    names are assigned by :func:`column_map` and joined back as a literal map.
    """
    names = column_map(predicates)
    if not names:
        return catalogue.select("p", F.lit(None).cast("string").alias("column"), "is_complex").limit(0)
    lookup = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv])
    return catalogue.where(F.col("p").isin(list(names))).select(
        "p", lookup[F.col("p")].alias("column"), "is_complex"
    )


def predicate_profile(stats: DataFrame) -> DataFrame:
    """Statistics plus ``avg_multiplicity`` and the cost score.

    ``cost = size * log_1.2(distinct_subjects)``; both use real division and a
    zero count gives NULL instead of a division error.
    """
    distinct = F.nullif(F.col("distinct_subjects"), F.lit(0)).cast("double")
    return stats.select(
        "p",
        "size",
        "distinct_subjects",
        "is_complex",
        F.round(F.col("size") / distinct, 4).alias("avg_multiplicity"),
        F.round(F.col("size") * F.log(distinct) / F.lit(math.log(COST_LOG_BASE)), 4).alias("cost"),
    )


def lookup_stats(stats: DataFrame, wanted: DataFrame) -> DataFrame:
    """Statistics of the predicates in ``wanted(p)``; unknown ones get -1.

    ``wanted`` holds the predicates of one query, so the left side is tiny;
    the join runs as a broadcast of whichever side Spark finds small.
    """
    joined = wanted.select("p").distinct().join(stats, "p", "left")
    return joined.select(
        "p",
        F.coalesce("size", F.lit(-1).cast("bigint")).alias("size"),
        F.coalesce("distinct_subjects", F.lit(-1).cast("bigint")).alias("distinct_subjects"),
        "is_complex",
    )
