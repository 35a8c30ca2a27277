"""From raw documents to packed training windows, one operator a stage.

Each function of ``STAGES`` takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoframe.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from spoframe.llm.common import own_name, quoted, table, written
from spoframe.llm.queries import label_domains, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects."""
    # the document's columns stand aside, whatever they are called
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_document"), "doc_id", "text")
    stats = written(quality_rules.with_text_stats(whole).drop("text"), "quality-stats")
    rules = quality_rules.fit_rules(stats, table(spark, sf_dir, "labels"))
    return quality_rules.quality_verdicts(stats, rules).filter("kept").select("_document.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    out = line_dedup.drop_boilerplate(docs, n_chars_col="n_chars")
    return out.select([F.col(quoted(c)) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a Jaccard similarity of 0.8 or more on 5-word shingles: the smallest id."""
    return ngram_join.one_of_each(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says: clean tokens are kept, toxic and low ones go to 0."""
    model = mixing.fit_domains(docs, label_domains(table(spark, sf_dir, "labels")))
    # a rate follows from the text, so rows without an id or with a repeated one find their own by id and text
    same, key, text, n = (own_name(docs, x) for x in ("_same", "_id", "_text", "_copies"))
    named = docs.withColumn(same, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    scored = written(mixing.score(named.select("doc_id", same, "text"), model), "mix-scored")
    sums = [F.sum(F.col("tokens") * F.get("posteriors", F.lit(k))).alias(d) for k, d in enumerate(model.domains)]
    now = scored.agg(*sums).first().asDict() if sums else {}
    targets = [(now[d] or 0.0) if d == "clean" else 0.0 for d in model.domains]
    rated = mixing.with_rates(scored, mixing.fit_rates(scored, targets, high=1.0))
    copies = rated.groupBy(F.col("doc_id").alias(key), F.col(same).alias(text)).agg(F.max("copies").alias(n))
    joined = named.join(copies, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(same) == F.col(text)))
    repeated = joined.select(*[F.col(quoted(c)) for c in docs.columns], F.explode(F.array_repeat(F.lit(1), F.col(n).cast("int"))))
    return repeated.select([F.col(quoted(c)) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: The last stages (tokenizer, differencing) cannot be said in SQL; the tests
#: hold the whole run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
