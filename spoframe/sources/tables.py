"""Triples derived from relational tables (the test-data mapping).

Each source row gives one triple per mapped column: subject
``<entity>/<key>``, predicate ``<http://ex.org/NAME>``, object the column's
text, a reference ``<entity>/<key>``, or a date as ``yyyy-MM-dd``.  Rows whose
key or value is NULL give no triple.  Duplicates are kept (``UNION ALL``).

Each table is scanned once: a row becomes an array of its ``(p, o)`` pairs,
which is exploded, so all triples of a row come from one pass over it.  Rows of
one subject stay together until the first shuffle, and map-side aggregates on
the subject shrink them there.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The table -> triple mapping of the test data.
PREDICATE_NAMESPACE = "http://ex.org/"
# (table, subject entity, key column, [(NAME, kind, column)]); kind is
# "text", "date", or "ref:<entity>".
TABLE_TRIPLES = [
    ("region", "region", "r_regionkey", [("name", "text", "r_name")]),
    ("nation", "nation", "n_nationkey", [
        ("name", "text", "n_name"),
        ("inRegion", "ref:region", "n_regionkey"),
    ]),
    ("customer", "customer", "c_custkey", [
        ("name", "text", "c_name"),
        ("segment", "text", "c_mktsegment"),
        ("inNation", "ref:nation", "c_nationkey"),
    ]),
    ("supplier", "supplier", "s_suppkey", [
        ("name", "text", "s_name"),
        ("inNation", "ref:nation", "s_nationkey"),
    ]),
    ("part", "part", "p_partkey", [
        ("name", "text", "p_name"),
        ("brand", "text", "p_brand"),
        ("type", "text", "p_type"),
        ("size", "text", "p_size"),
    ]),
    ("orders", "order", "o_orderkey", [
        ("placedBy", "ref:customer", "o_custkey"),
        ("status", "text", "o_orderstatus"),
        ("priority", "text", "o_orderpriority"),
        ("date", "date", "o_orderdate"),
    ]),
    ("lineitem", "order", "l_orderkey", [
        ("hasPart", "ref:part", "l_partkey"),
        ("hasSupplier", "ref:supplier", "l_suppkey"),
    ]),
    ("events", "user", "user_id", [("did", "text", "event_type")]),
]


def predicate(name: str) -> str:
    """The full predicate for a mapping NAME, e.g. ``<http://ex.org/name>``."""
    return f"<{PREDICATE_NAMESPACE}{name}>"


def _object(kind: str, column: str) -> Column:
    c = F.col(column)
    if kind == "text":
        return c.cast("string")
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if kind.startswith("ref:"):
        return F.concat(F.lit(kind[4:] + "/"), c.cast("string"))
    raise ValueError(f"unknown object kind {kind!r}")


def triples_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(s, p, o)`` triples for the tables under ``sf_dir``."""
    parts = []
    for table, entity, key, columns in TABLE_TRIPLES:
        src = spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
        subject = F.concat(F.lit(entity + "/"), F.col(key).cast("string"))
        pairs = [
            F.struct(F.lit(predicate(name)).alias("p"), _object(kind, column).alias("o"))
            for name, kind, column in columns
        ]
        rows = src.where(F.col(key).isNotNull()).select(subject.alias("s"), F.inline(F.array(*pairs)))
        parts.append(rows.where(F.col("o").isNotNull()).select("s", "p", "o"))
    return reduce(DataFrame.unionAll, parts)
