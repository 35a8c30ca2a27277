"""Token totals kept up to date by signed changes.

A rollup is a folder of committed batches, whole in itself: it can be moved or
copied, and nothing outside it is read.  Each batch adds

* entries: one signed row per changed document and tokenizer version, and
* deltas: the entries summed by source, language and tokenizer version.

An insert adds a document's count, a delete takes back what the earlier
batches' entries say about it, and a revision does both, so that totals are
sums of deltas and no text is counted again.  A batch is written to a folder
of its attempt and becomes visible by its commit row, written last; a batch
whose id is committed already changes nothing, and what an interrupted attempt
left is never read.  One writer at a time.

Earlier entries are looked up by a join on the changed documents; sums combine
before the shuffle, so a hot source is no burden.

Defined results: every insert or revision with a NULL id counts as a document
of its own that cannot be revised or deleted later; NULL source, language and tokenizer are groups of their own; several
changes of one document and tokenizer in a batch are applied as: delete if any
is a delete, else the largest count; deleting an unknown document, or
inserting a known one with the same count, adds nothing; NULL counts are 0.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoframe.llm.common import quoted, ship_package, squeezed, words_of
from spoframe.llm.tokens import slices, tokenizer

KEYS = ["source", "lang", "tokenizer"]
CHANGES = "op string, doc_id long, source string, lang string, tokenizer string, tokens long"
ENTRIES = "doc_id long, source string, lang string, tokenizer string, documents long, tokens long"
DELTAS = "source string, lang string, tokenizer string, documents long, tokens long"
#: Texts that a task takes out of a batch at a time.
TEXTS = 1000
#: ``folder`` is relative to the rollup's.
COMMITS = "batch_id string, folder string"


class TokenRollup:
    """The rollup in a folder; ``compact`` folds the committed batches into one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _commits(self) -> DataFrame:
        schema = self.spark.createDataFrame([], COMMITS).schema
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/commits/*")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":  # nothing is committed yet
                return self.spark.createDataFrame([], schema)
            raise

    def _folders(self) -> dict[str, str]:
        """Batch id -> folder (one row a batch)."""
        return {r["batch_id"]: f"{self.folder}/{r['folder']}" for r in self._commits().collect()}

    def _fresh(self) -> str:
        """The folder of a new attempt."""
        return f"{self.folder}/batches/{uuid.uuid4().hex}"

    def _read(self, what: str, schema: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{f}/{what}" for f in sorted(set(folders))])

    def entries(self) -> DataFrame:
        """What is counted now: one row a document and tokenizer version."""
        rows = self._read("entries", ENTRIES, list(self._folders().values()))
        summed = rows.groupBy("doc_id", *KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return summed.filter("documents > 0")

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer version."""
        rows = self._read("deltas", DELTAS, list(self._folders().values()))
        summed = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return summed.filter("documents <> 0 OR tokens <> 0")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (:data:`CHANGES`; op: insert, revise or delete) once; False if done before."""
        known = self._folders()
        if batch_id in known:
            return False
        folder = self._fresh()
        wanted = (
            changes.filter("doc_id IS NOT NULL")
            .groupBy("doc_id", "tokenizer")
            .agg(
                F.max(F.col("op") == "delete").alias("gone"),
                F.max(F.struct(F.coalesce("tokens", F.lit(0)).alias("tokens"), "source", "lang")).alias("x"),
            )
        )
        wanted = wanted.select(
            "doc_id", "tokenizer", "x.source", "x.lang", "gone",
            F.when(F.col("gone"), 0).otherwise(1).cast("long").alias("documents"),
            F.when(F.col("gone"), 0).otherwise(F.col("x.tokens")).cast("long").alias("tokens"),
        )
        anonymous = changes.filter("doc_id IS NULL AND op <> 'delete'").select(
            "doc_id", "tokenizer", "source", "lang", F.lit(1).cast("long").alias("documents"),
            F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"),
        )
        new = wanted.filter("NOT gone").drop("gone").unionByName(anonymous)
        rows = new
        if known:
            changed = wanted.select("doc_id", F.col("tokenizer").alias("_tokenizer"))
            earlier = self._read("entries", ENTRIES, list(known.values()))
            same = (earlier["doc_id"] == changed["doc_id"]) & earlier["tokenizer"].eqNullSafe(changed["_tokenizer"])
            before = earlier.join(changed, same, "left_semi")
            taken = before.withColumns({"documents": -F.col("documents"), "tokens": -F.col("tokens")})
            rows = new.unionByName(taken)
        signed = (
            rows.groupBy("doc_id", *KEYS)
            .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
            .filter("documents <> 0 OR tokens <> 0")
        )
        signed.write.parquet(f"{folder}/entries")
        self._add_deltas(folder)
        self._publish(batch_id, folder)
        return True

    def _add_deltas(self, folder: str) -> None:
        rows = self.spark.read.schema(ENTRIES).parquet(f"{folder}/entries")
        deltas = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        deltas.write.parquet(f"{folder}/deltas")

    def _publish(self, batch_id: str, folder: str) -> None:
        name = folder.rsplit("/", 1)[1]
        row = self.spark.createDataFrame([(batch_id, f"batches/{name}")], COMMITS).coalesce(1)
        row.write.mode("errorifexists").parquet(f"{self.folder}/commits/{name}")

    def compact(self, into: str) -> TokenRollup:
        """A new rollup at ``into`` with the current entries in one batch and all batch ids known."""
        known = self._folders()
        out = TokenRollup(self.spark, into)
        folder = out._fresh()
        self.entries().write.parquet(f"{folder}/entries")
        self._add_deltas(folder)
        rows = [(b, folder.removeprefix(f"{out.folder}/")) for b in sorted(known)]
        if rows:
            self.spark.createDataFrame(rows, COMMITS).coalesce(1).write.parquet(f"{out.folder}/commits/base")
        return out


def count_tokens(
    docs: DataFrame, version: str, tokenizer_path: str | None = None, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Insert changes for ``docs`` (doc_id, source, lang, text): tokens of each whole text.

    Without a tokenizer's file, words between white space are counted.
    """
    ship_package(docs.sparkSession)
    text = F.col(quoted(text_col))
    if tokenizer_path is None:
        tokens = F.size(words_of(squeezed(text))).cast("long")
    else:

        @F.arrow_udf("long")
        def tokens_of(texts: pa.Array) -> pa.Array:
            count, found = tokenizer(tokenizer_path).counts, []
            for at in range(0, len(texts), TEXTS):
                values = [x or "" for x in texts.slice(at, TEXTS).to_pylist()]
                found += [n for a, b in slices(values) for n in count(values[a:b])]
            return pa.array(found, pa.int64())

        tokens = tokens_of(text)
    return docs.select(
        F.lit("insert").alias("op"),
        F.col(quoted(id_col)).cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(version).alias("tokenizer"),
        tokens.alias("tokens"),
    )
