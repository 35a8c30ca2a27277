"""A1: tab-separated triple text source (and its writer, for round trips).

One triple per line, ``subject<TAB>predicate<TAB>object``; further fields are
ignored; lines with fewer than three fields are rejected.  An empty field is
an empty string, never NULL (the CSV reader would turn it into NULL, so the
text reader plus ``split`` is used instead).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLE_SCHEMA = "s string, p string, o string"
#: Lines of one compressed file, which only one task can read.
FILE_LINES = 500_000


class TripleText(NamedTuple):
    triples: DataFrame  # s, p, o
    rejected: DataFrame  # line


def triple_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, ok, s, p, o)``: every line, whether it is a triple, and its fields if so.

    Lines end at ``\\n`` only, as in a newline-terminated text table: in a
    CRLF file the ``\\r`` stays part of the object.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    fields = lines.select(F.col("value").alias("line"), F.split("value", "\t", -1).alias("f"))
    ok = F.size("f") >= 3
    parts = [F.when(ok, F.get("f", i)).alias(c) for i, c in enumerate("spo")]
    return fields.select("line", ok.alias("ok"), *parts)


def read_triples(spark: SparkSession, path: str) -> TripleText:
    """Read tab-separated triples; returns the triples and the rejected lines.

    Both outputs are lazy views of the same scan: counting the rejected lines
    is a separate, optional job (``load_text`` counts them in the load's pass).
    """
    lines = triple_lines(spark, path)
    return TripleText(lines.where("ok").select("s", "p", "o"), lines.where("NOT ok").select("line"))


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    """Write the one string column of ``lines`` as text lines that end at ``\\n``.

    With a ``compression`` (``gzip``, ...) a task writes a file for every ``FILE_LINES``
    lines, so that readers can share them: a compressed file is not split.  The text is
    read once or so, so it is compressed quickly rather than well.
    """
    options = {"lineSep": "\n", "compression": compression}
    if compression != "none":
        options |= {"maxRecordsPerFile": FILE_LINES, "zlib.compress.level": "BEST_SPEED"}
    lines.write.mode(mode).options(**options).text(path)


def write_triples(triples: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    """Write ``(s, p, o)`` as tab-separated text lines (``compression``: see :func:`write_lines`).

    Values holding a tab or a newline cannot be represented in this format;
    the writer refuses them, and NULLs, instead of writing lines that read back wrong.
    """
    bad = F.col("s").rlike("[\t\n]") | F.col("p").rlike("[\t\n]") | F.col("o").rlike("[\t\n]")
    null = F.col("s").isNull() | F.col("p").isNull() | F.col("o").isNull()
    line = F.when(null | bad, F.raise_error(F.lit("triple value is NULL or holds a tab or newline"))).otherwise(
        F.concat_ws("\t", "s", "p", "o")
    )
    write_lines(triples.select(line.alias("value")), path, mode, compression)
