"""The layouts a query can read, bundled: partitioned rows, property table, statistics."""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spoframe.operators.list_store import CHUNK_VALUES, list_chunks, list_sizes
from spoframe.operators.profile import catalogue_from_stats, predicate_stats, with_columns
from spoframe.operators.property_table import (
    PTColumn,
    columns_from_catalogue,
    plan_columns,
    property_table,
)
from spoframe.session import bucket_session, load_session, load_settings, shared_dir, task_count
from spoframe.sources.layouts import (
    complete_triples,
    only_predicates,
    predicate_id,
    quoted,
    read_catalogue,
    read_lists,
    read_property_table,
    read_stats,
    read_subject_files,
    read_vp,
    scan_vp,
    subject_files,
    write_catalogue,
    write_lists,
    write_property_table,
    write_stats,
    write_subject_files,
    write_vp,
)
from spoframe.sources.text import triple_lines


@dataclass
class TripleStore:
    """What :func:`spoframe.plans.match.match` reads.

    ``vp`` holds ``(s, o, p)``: a stored partitioned layout (a scan for one
    predicate is partition pruned) or any triple DataFrame.  The property
    table and statistics are optional.
    """

    vp: DataFrame
    property_table: DataFrame | None = None
    pt_columns: dict[str, PTColumn] = field(default_factory=dict)
    stats: DataFrame | None = None
    #: Values of the multi-valued predicates in chunks; the property table then holds their numbers of values.
    lists: DataFrame | None = None
    #: The property table's files by subject, and where the table is.
    files: DataFrame | None = None
    property_path: str | None = None
    #: Folder of the loaded version, and its manifest row, of a stored one.
    folder: str | None = None
    manifest: dict | None = None
    _stat_rows: dict[str, tuple[int, int, int]] = field(default_factory=dict, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.vp.sparkSession

    def rows(self, p: str) -> DataFrame:
        """``(s, o)`` of one predicate."""
        return scan_vp(self.vp, p)

    def properties_of(self, subject: str) -> DataFrame:
        """The property table for one subject: only the files that may hold it are opened where there is an index."""
        if self.files is None:
            return self.property_table
        return read_property_table(self.spark, self.property_path, subject, self.files)

    def stats_for(self, predicates) -> dict[str, tuple[int, int, int]] | None:
        """``p -> (size, distinct_subjects, distinct_objects)`` for a query's predicates.

        Fetched once per predicate and kept on the store (the statistics of a
        store do not change); unknown predicates are absent from the result.
        """
        if self.stats is None:
            return None
        missing = sorted(set(predicates) - set(self._stat_rows))
        if missing:
            rows = (
                self.stats.where(F.col("p").isin(missing))
                .select("p", "size", "distinct_subjects", "distinct_objects")
                .collect()
            )  # at most one row per requested predicate
            for r in rows:
                self._stat_rows[r["p"]] = (r["size"], r["distinct_subjects"], r["distinct_objects"])
        return {p: self._stat_rows[p] for p in predicates if p in self._stat_rows}

    @classmethod
    def from_triples(
        cls,
        triples: DataFrame,
        *,
        property_table_columns: list[PTColumn] | None = None,
        with_property_table: bool = False,
        with_stats: bool = False,
        predicates: list[str] | None = None,
    ) -> TripleStore:
        """A store over in-memory triples; the layouts stay lazy plans.

        The statistics (one row per predicate) are computed once and
        checkpointed to the shared folder when they are needed: for choosing
        the property-table columns or for join ordering (``with_stats``).
        """
        triples = complete_triples(triples)
        stats = predicate_stats(triples)
        if with_stats or (with_property_table and property_table_columns is None):
            shared_dir(triples.sparkSession)
            stats = stats.checkpoint(eager=True)
        cols = property_table_columns
        if cols is None and with_property_table:
            cols = plan_columns(stats, predicates)
        pt = property_table(triples, cols) if cols else None
        return cls(
            vp=triples.select("s", "o", "p"),
            property_table=pt,
            pt_columns={c.p: c for c in cols or []},
            stats=stats if with_stats else None,
        )

    @classmethod
    def open(cls, spark: SparkSession, base: str) -> TripleStore:
        """Open what the last finished :func:`load_store` at ``base`` wrote."""
        manifest = last_manifest(spark, base)
        if manifest is None:
            raise FileNotFoundError(f"no finished load at {base}")
        folder = os.path.join(base, manifest["folder"])
        store = cls.open_folder(spark, folder, manifest["has_property_table"], bool(manifest["has_lists"]))
        store.manifest = manifest
        return store

    @classmethod
    def open_folder(cls, spark: SparkSession, folder: str, has_property_table: bool, has_lists: bool = False) -> TripleStore:
        """Open the layouts in one folder."""
        vp = read_vp(spark, os.path.join(folder, "vp"))
        stats = read_stats(spark, os.path.join(folder, "stats"))
        if not has_property_table:
            return cls(vp=vp, stats=stats, folder=folder)
        catalogue = read_catalogue(spark, os.path.join(folder, "catalogue"))
        path = os.path.join(folder, "property_table")
        table = read_property_table(spark, path)
        cols = columns_from_catalogue(catalogue, table)
        return cls(
            vp=vp, property_table=table, pt_columns={c.p: c for c in cols}, stats=stats, folder=folder,
            lists=read_lists(spark, os.path.join(folder, "lists")) if has_lists else None,
            files=read_subject_files(spark, os.path.join(folder, "property_files")) if has_lists else None,
            property_path=path,
        )

    @classmethod
    def open_database(cls, spark: SparkSession, database: str) -> TripleStore:
        """Open the tables that :func:`load_tables` wrote, by the database's name."""
        table = lambda name: spark.table(f"{quoted(database)}.{quoted(name)}")
        properties = table("property_table")
        cols = columns_from_catalogue(table("catalogue"), properties)
        return cls(
            vp=table("triples"), property_table=properties, pt_columns={c.p: c for c in cols},
            stats=table("stats"), lists=table("lists"),
        )


MANIFEST = (
    "load_id string, folder string, has_property_table boolean, triples long, null_rows long, "
    "has_lists boolean, rejected_lines long"
)


def last_manifest(spark: SparkSession, base: str) -> dict | None:
    """The manifest row of the last finished load at ``base``, if any."""
    try:
        row = spark.read.schema(MANIFEST).parquet(os.path.join(base, "manifests")).orderBy(F.desc("load_id")).first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return row.asDict() if row else None


def property_rows(
    vp: DataFrame, lists: DataFrame, cols: list[PTColumn], tasks: int | None = None, ranged: bool = False,
    in_place: bool = False,
) -> DataFrame:
    """The stored property table: a value for each single-valued predicate, the number of values for each other one.

    No cell grows with a subject's number of values; those are in ``lists``.
    ``in_place``: both tables are bucketed by subject, so no row is dealt.
    """
    single = [c.p for c in cols if not c.is_list]
    rows = only_predicates(vp, single).select("s", "p", "o")
    sizes = list_sizes(lists).select("s", "p", F.col("n").cast("string").alias("o"))
    plain = lambda kept: [PTColumn(c.p, c.column, False) for c in kept]
    if in_place and 0 < len(single) < len(cols):  # a union would be dealt; a join of buckets is not
        values = property_table(rows, plain(c for c in cols if not c.is_list), in_place=True)
        table = values.join(property_table(sizes, plain(c for c in cols if c.is_list), in_place=True), "s", "full")
    else:
        table = property_table(rows.unionByName(sizes), plain(cols), tasks, ranged)
    counts = {c.column: F.col(quoted(c.column)).cast("bigint") for c in cols if c.is_list}
    return table.select("s", *[counts.get(c.column, F.col(quoted(c.column))).alias(c.column) for c in cols])


def _lists_of(
    vp: DataFrame, stats: DataFrame, cols: list[PTColumn], chunk_values: int, tasks: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """The chunked lists of the multi-valued columns; the statistics say which of them have long ones."""
    listed = [c.p for c in cols if c.is_list]
    short = stats.where((F.col("max_multiplicity") <= chunk_values) & F.col("p").isin(listed)).select("p").collect()
    return list_chunks(vp, listed, chunk_values, short=sorted(r["p"] for r in short), tasks=tasks, buckets=buckets)


def write_property_layout(
    vp: DataFrame, stats: DataFrame, cols: list[PTColumn], folder: str, chunk_values: int = CHUNK_VALUES,
    tasks: int | None = None,
) -> None:
    """Catalogue, chunked lists, property table and its file index, each a written table."""
    spark = vp.sparkSession
    write_catalogue(with_columns(catalogue_from_stats(stats), [c.p for c in cols]), os.path.join(folder, "catalogue"))
    write_lists(_lists_of(vp, stats, cols, chunk_values, tasks), os.path.join(folder, "lists"))
    lists = read_lists(spark, os.path.join(folder, "lists"))
    path = os.path.join(folder, "property_table")
    write_property_table(property_rows(vp, lists, cols, tasks, ranged=True), path, ranged=True)
    write_subject_files(subject_files(read_property_table(spark, path)), os.path.join(folder, "property_files"))


def load_store(
    triples: DataFrame,
    base: str,
    *,
    with_property_table: bool = True,
    predicates: list[str] | None = None,
    mode: str = "errorifexists",
    chunk_values: int = CHUNK_VALUES,
    rejected: Observation | None = None,
) -> TripleStore:
    """Write every layout to a new folder under ``base``, publish it, and open it.

    The triples are parsed once: the partitioned layout is written first and
    the statistics and property table are computed from it (columnar reads
    of ``s``/``o`` plus the partition value).  Each step is a written table,
    so a lost executor only re-runs the step it was in.  The manifest row
    (which parts exist, rows written and rows dropped for a NULL part) is
    written last: until then, and if the load dies, readers see the load
    before it, whole.  Earlier folders are left for their readers.
    One writer at a time.  ``rejected``: an observation made on the way to
    ``triples`` that counts ``rejected`` lines (see :func:`load_text`).
    """
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"mode must be 'errorifexists' or 'overwrite', got {mode!r}")
    spark = triples.sparkSession
    if mode == "errorifexists" and last_manifest(spark, base) is not None:
        raise FileExistsError(f"a store exists at {base}")
    load_id = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    folder = os.path.join(base, f"load-{load_id}")
    seen = Observation()
    null = F.col("s").isNull() | F.col("p").isNull() | F.col("o").isNull()
    counted = triples.observe(seen, F.count(F.when(~null, 1)).alias("triples"), F.count(F.when(null, 1)).alias("null"))
    with load_settings(spark):
        write_vp(counted, os.path.join(folder, "vp"))
    # what follows holds counts and lists in memory: in small tasks
    own = load_session(spark, seen.get["triples"])
    vp = read_vp(own, os.path.join(folder, "vp"))
    write_stats(predicate_stats(vp), os.path.join(folder, "stats"))
    stats = read_stats(own, os.path.join(folder, "stats"))
    cols = plan_columns(stats, predicates) if with_property_table else []
    if cols:
        write_property_layout(vp, stats, cols, folder, chunk_values, task_count(seen.get["triples"]))
    lost = rejected.get["rejected"] if rejected is not None else 0
    row = (load_id, os.path.basename(folder), bool(cols), seen.get["triples"], seen.get["null"], bool(cols), lost)
    manifest = spark.createDataFrame([row], MANIFEST).coalesce(1)
    manifest.write.mode("append").parquet(os.path.join(base, "manifests"))
    return TripleStore.open(spark, base)


def load_text(spark: SparkSession, path: str, base: str, **options) -> TripleStore:
    """A1 + :func:`load_store`: tab-separated triples into a store, in one pass over the text.

    The lines that are no triples are counted in the pass that writes the
    partitioned rows, and stand in the manifest (``rejected_lines``).
    """
    seen = Observation()
    lines = triple_lines(spark, path).observe(seen, F.count_if(~F.col("ok")).alias("rejected"))
    return load_store(lines.where("ok").select("s", "p", "o"), base, rejected=seen, **options)


def load_tables(
    triples: DataFrame,
    database: str,
    *,
    buckets: int | None = None,
    predicates: list[str] | None = None,
    chunk_values: int = CHUNK_VALUES,
    location: str | None = None,
) -> TripleStore:
    """A2 with A4, A5, A7, A8: every layout as a catalog table of ``database``, bucketed by subject.

    Rows of a subject lie in the same bucket of all tables (and of all
    predicates), so joins on subjects need no shuffle.  ``buckets`` says into how
    many tasks such a join is cut: about the size of the triples over that of a
    scan task, which is the default (8 at least).  A subject with very many rows makes its bucket large; the
    layouts of :func:`load_store` split it.  The tables lie in the warehouse, or
    in the folder ``location``.

    The triples are dealt into the buckets once.  Statistics, lists and property
    table are made bucket by bucket from the table that this writes: only the
    distinct objects of a scan task, and lists too long for a chunk, are shuffled.
    """
    spark = triples.sparkSession
    where = "" if location is None else " LOCATION '" + location.replace("\\", "\\\\").replace("'", "\\'") + "'"
    spark.sql(f"CREATE DATABASE {quoted(database)}{where}")

    def save(df: DataFrame, name: str, by_subject: bool = True, parts: tuple[str, ...] = ()) -> None:
        writer = df.write.format("parquet")
        if parts:
            writer = writer.partitionBy(*parts)
        if by_subject:  # the rows lie as the buckets do, so that a task writes one file a bucket and predicate
            writer = writer.bucketBy(buckets, "s").sortBy("s")
        writer.saveAsTable(f"{quoted(database)}.{quoted(name)}")

    rows = complete_triples(triples).select("s", "o", "p", predicate_id("p").alias("pid"))
    with load_settings(spark):
        total = rows.count()
        tasks = task_count(total)
        buckets = max(8, tasks) if buckets is None else buckets
        save(rows.repartition(buckets, "s"), "triples", parts=("pid",))
    own = bucket_session(spark, total)
    table = lambda name: own.table(f"{quoted(database)}.{quoted(name)}")
    vp = table("triples")
    save(predicate_stats(vp, in_place=True), "stats", by_subject=False)
    stats = table("stats")
    cols = plan_columns(stats, predicates)
    save(with_columns(catalogue_from_stats(stats), [c.p for c in cols]), "catalogue", by_subject=False)
    chunks = _lists_of(vp, stats, cols, chunk_values, tasks, buckets)
    save(chunks.withColumn("pid", predicate_id("p")), "lists", parts=("pid",))
    save(property_rows(vp, table("lists"), cols, in_place=True), "property_table")
    return TripleStore.open_database(spark, database)
