"""Session helpers: the shared folder for written intermediates."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    Intermediate tables and checkpoints go there so that any executor (and a
    retried task after an executor loss) can read them.  Only a local-mode
    session without the setting (tests, a laptop) gets a fresh temporary
    folder; on a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session: only the setting is visible
        if configured:
            return configured.rstrip("/")
        raise ValueError("spark.checkpoint.dir is not set; set it to a folder every executor can reach")
    found = sc.getCheckpointDir() or configured
    if found:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(found)
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError(
            "spark.checkpoint.dir is not set; set it to a folder every executor can reach"
        )
    local = tempfile.mkdtemp(prefix="spoframe-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def application_id(spark: SparkSession) -> str:
    """The running application's id (works for classic and remote sessions)."""
    return spark.conf.get("spark.app.id", None) or spark.sparkContext.applicationId


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder (one per run)."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared folder and read back.

    Cuts lineage: any executor can read the files, also after the one that
    wrote them is lost, and Spark knows sizes and column statistics.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote, wherever Spark keeps it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Triples of one task of a shuffle whose width goes by the number of triples.
TASK_ROWS = 1_000_000
#: Bytes of stored triples in a scan task of a load: about as many rows.
SCAN_BYTES = 8 << 20
#: With it, a job's shuffle files go when the job ends; else they stay until the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def task_count(rows: int) -> int:
    """Tasks for a shuffle of ``rows`` triples: a task's share does not grow with the input."""
    return max(math.ceil(rows / TASK_ROWS), min(16, math.ceil(rows / 5_000)), 1)


def load_session(spark: SparkSession, rows: int) -> SparkSession:
    """A session of the same application, with the caller's settings, whose tasks stay small for ``rows`` triples.

    What an aggregate holds in memory goes by the rows of its task, before the
    shuffle (a scan task) and after it, so both are bounded here; the caller's
    session stays as it is.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.shuffle.partitions", max(width, task_count(rows)))
    own.conf.set("spark.sql.files.maxPartitionBytes", SCAN_BYTES)
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", 4 * SCAN_BYTES)
    own.conf.set(FREED, True)
    return own


def bucket_session(spark: SparkSession, rows: int) -> SparkSession:
    """:func:`load_session` for a load of bucketed tables, whose files are many: a scan task is a bucket or about its size."""
    own = load_session(spark, rows)
    own.conf.set("spark.sql.sources.bucketing.enabled", True)
    own.conf.set("spark.sql.files.openCostInBytes", SCAN_BYTES >> 7)
    return own


@contextmanager
def load_settings(spark: SparkSession) -> Iterator[None]:
    """The caller's session for the first job of a load, which reads the caller's DataFrame.

    Its scan tasks are small, so that none writes more to a shuffle than it can hold,
    and its shuffle files go when it ends.  The settings are as before after the block.
    """
    set_before = dict(spark.conf.getAll.items())
    keys = {"spark.sql.files.maxPartitionBytes": SCAN_BYTES, FREED: True}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key in keys:
            if key in set_before:
                spark.conf.set(key, set_before[key])
            else:
                spark.conf.unset(key)


class Scratch:
    """A folder of intermediates in the shared folder that goes when its ``with`` block ends.

    Use the results inside the block: they read the intermediates.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = fresh_path(spark, "scratch")
        self.tables = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a Parquet table of this folder."""
        path = os.path.join(self.path, uuid.uuid4().hex)
        df.write.parquet(path)
        self.tables += 1
        return self.spark.read.schema(df.schema).parquet(path)

    def place(self, name: str) -> str:
        """A path in this folder for what the caller writes."""
        self.tables += 1
        return os.path.join(self.path, f"{name}-{uuid.uuid4().hex}")

    def close(self) -> None:
        if self.tables:
            delete_path(self.spark, self.path)
            self.tables = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        self.close()
