"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoframe.session import fresh_path

#: White space between words: space, tab, line feed, vertical tab, form feed,
#: carriage return.  Everything else belongs to a word.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.mkdtemp(prefix="spoframe-package-"), "spoframe-package.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in sorted(os.walk(top)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared folder and read back.

    Cuts lineage without a cache: any executor can read the files, also after
    the one that wrote them is lost, and Spark knows their size when it plans
    what follows.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_buckets(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df`` written once under the shared folder in hash buckets of ``column``, and read back.

    There are as many buckets as shuffle partitions, so that what is dealt by
    ``column`` later meets these rows where they lie: they need no shuffle.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    known = path.rsplit("/", 1)[1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).bucketBy(n, column).saveAsTable(known)
    return spark.table(known)


def own_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores in front until ``df`` has no such column (any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select([df[quoted(c)] for c in df.columns if c.lower() not in taken])


def quoted(name: str) -> str:
    """A column name that may hold dots or back-ticks."""
    return "`" + name.replace("`", "``") + "`"


def squeezed(text: Column) -> Column:
    """Text with each run of white space as one space, none at the ends; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " "))


def words_of(squeezed_text: Column) -> Column:
    """The words of a :func:`squeezed` text; no words give an empty array."""
    return F.when(squeezed_text == "", F.array().cast("array<string>")).otherwise(F.split(squeezed_text, " "))


def shifted(items: Column, by: int) -> Column:
    """An array without its first ``by`` items."""
    return F.slice(items, by + 1, F.size(items))
