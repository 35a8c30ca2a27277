"""Readers and writers for the stored layouts (A3-A10).

* partitioned layout: one Parquet dataset with ``s, o, p`` partitioned by
  ``pid = xxhash64(p)``.  A scan for one predicate filters ``pid`` (constant
  folded, so it is a partition-pruned directory listing) and ``p`` (exact,
  even if two predicates ever shared an id).  Directory names stay short and
  any predicate text works, including ``""`` and very long IRIs, which Hive
  style ``p=<value>`` directories cannot hold.
* property table: one row per subject, Parquet.
* catalogue ``(p, column, is_complex)`` and statistics, Parquet.
* query results, Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VP_SCHEMA = "s string, o string, p string, pid bigint"
STATS_SCHEMA = (
    "p string, size bigint, distinct_subjects bigint, distinct_objects bigint, "
    "max_multiplicity bigint, is_complex boolean"
)
LISTS_SCHEMA = "s string, p string, chunk bigint, values array<string>, counts array<bigint>, pid bigint"
CATALOGUE_SCHEMA = "p string, column string, is_complex int"
#: Row groups of the partitioned rows, before compression.
ROW_GROUP_BYTES = 16 << 20


def predicate_id(p: Column | str) -> Column:
    """The partition id of a predicate (a 64-bit hash of its text)."""
    return F.xxhash64(F.col(p) if isinstance(p, str) else p)


def complete_triples(triples: DataFrame) -> DataFrame:
    """Rows with a NULL subject, predicate or object are not triples; drop them."""
    return triples.where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull())


def write_vp(triples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A4: all predicates in one job, one directory per predicate.

    With adaptive execution on (the default), ``rebalance`` lets AQE cut a
    predicate that holds a large share of all rows into several evenly sized
    files and pack small predicates together.  With it off, range
    partitioning on ``(pid, s, o)`` does the splitting from sampled bounds.
    Sorting by subject inside each file gives tight row-group ranges on ``s``
    so a constant-subject filter skips row groups.  Rows with a NULL part
    are dropped (:func:`complete_triples`).
    """
    rows = complete_triples(triples).select("s", "o", "p", predicate_id("p").alias("pid"))
    if triples.sparkSession.conf.get("spark.sql.adaptive.enabled", "true").lower() == "true":
        rows = rows.hint("rebalance", "pid")
    else:
        rows = rows.repartitionByRange("pid", "s", "o")
    # a scan task takes whole row groups: small ones let a reader choose small tasks
    writer = rows.sortWithinPartitions("pid", "s").write.option("parquet.block.size", ROW_GROUP_BYTES)
    writer.mode(mode).partitionBy("pid").parquet(path)


def read_vp(spark: SparkSession, path: str) -> DataFrame:
    """The partitioned layout as ``(s, o, p, pid)``."""
    return spark.read.schema(VP_SCHEMA).parquet(path)


def only_predicates(rows: DataFrame, predicates: list[str]) -> DataFrame:
    """Rows of the given predicates; partition pruned when ``rows`` is stored."""
    preds = list(predicates)
    cond = F.col("p").isin(preds)
    if "pid" in rows.columns:
        cond = F.col("pid").isin([predicate_id(F.lit(x)) for x in preds]) & cond
    return rows.where(cond)


def scan_vp(vp: DataFrame, p: str) -> DataFrame:
    """A3 + B5: the ``(s, o)`` rows of one predicate (partition pruned when stored)."""
    cond = F.col("p") == F.lit(p)
    if "pid" in vp.columns:
        cond = (F.col("pid") == predicate_id(F.lit(p))) & cond
    return vp.where(cond).select("s", "o")


def write_property_table(table: DataFrame, path: str, mode: str = "overwrite", ranged: bool = False) -> None:
    """A5: the property table as Parquet, ranged over the files by subject and sorted in each.

    Subjects are distinct, so ranges from sampled bounds are even, and a
    subject lies in one file (see :func:`subject_files`).  A table that was built
    ``ranged`` is written as it lies: its rows are neither sampled nor shuffled again.
    """
    (table if ranged else table.repartitionByRange("s")).sortWithinPartitions("s").write.mode(mode).parquet(path)


def read_property_table(spark: SparkSession, path: str, subject: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """The property table; column pruning happens at the scan.

    With a ``subject`` and the table's ``index`` only the files that may hold it are opened.
    """
    if subject is None or index is None:
        return spark.read.parquet(path)
    held = index.where((F.col("first") <= F.lit(subject)) & (F.lit(subject) <= F.col("last")))
    files = [r["file"] for r in held.select("file").collect()]  # one, as ranges part the subjects
    schema = spark.read.parquet(path).schema
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def subject_files(table: DataFrame) -> DataFrame:
    """A file index of a stored table: ``(file, first, last)`` subject of each file."""
    return table.groupBy(F.input_file_name().alias("file")).agg(F.min("s").alias("first"), F.max("s").alias("last"))


def write_subject_files(index: DataFrame, path: str) -> None:
    """One small file: a row a file of the indexed table, by first subject."""
    index.orderBy("first").coalesce(1).write.parquet(path)


def read_subject_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, first string, last string").parquet(path)


def write_lists(lists: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Chunked lists ``(s, p, chunk, values, counts)``, one directory a predicate, like the partitioned rows."""
    rows = lists.select("s", "p", "chunk", "values", "counts", predicate_id("p").alias("pid"))
    rows.hint("rebalance", "pid").sortWithinPartitions("pid", "s").write.mode(mode).partitionBy("pid").parquet(path)


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """Chunked lists as ``(s, p, chunk, values, counts, pid)``."""
    return spark.read.schema(LISTS_SCHEMA).parquet(path)


def write_catalogue(catalogue: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The predicate catalogue ``(p, column, is_complex)``."""
    catalogue.select("p", "column", "is_complex").write.mode(mode).parquet(path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOGUE_SCHEMA).parquet(path)


def write_stats(stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Per-predicate statistics as a Parquet table."""
    cols = ["p", "size", "distinct_subjects", "distinct_objects", "max_multiplicity", "is_complex"]
    stats.select(*cols).write.mode(mode).parquet(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics written by :func:`write_stats`."""
    return spark.read.schema(STATS_SCHEMA).parquet(path)


def write_result(result: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A10: a query result, written under a caller-given path."""
    result.write.mode(mode).parquet(path)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def quoted(identifier: str) -> str:
    """A name that may hold dots or back-ticks."""
    return "`" + identifier.replace("`", "``") + "`"


def write_result_table(result: DataFrame, table: str, database: str | None = None, mode: str = "overwrite") -> str:
    """A2 + A10: a query result as a catalog table, creating the database if needed.

    Returns the qualified table name.  Names are quoted identifiers, never
    pasted as SQL text.
    """
    spark = result.sparkSession
    name = quoted(table)
    if database is not None:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(database)}")
        name = f"{quoted(database)}.{name}"
    result.write.mode(mode).format("parquet").saveAsTable(name)
    return name
