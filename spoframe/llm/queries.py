"""The registered queries of the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoframe.llm import byte_bpe, lexical, license_scan, line_dedup, mixing, ngram_join, packing, quality_rules, suffix_dedup, syncmers, warc, whitening
from spoframe.llm.common import squeezed, table, words_of, written
from spoframe.llm.token_rollup import TokenRollup, count_tokens
from spoframe.session import fresh_path


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file (not part of this repository)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; the rules come from ``labels``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = written(quality_rules.with_text_stats(docs).drop("text"), "quality-stats")
    rules = quality_rules.fit_rules(stats, table(spark, sf_dir, "labels"))
    return quality_rules.quality_verdicts(stats, rules)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (its source is the site) without boilerplate lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the end replaced by the next one's start."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = syncmers.with_anchors(docs, "text", "anchors").withColumn("tie", F.xxhash64("text"))
    near = {"next_text": "text", "next_anchors": "anchors"}
    rows = syncmers.with_next(docs, "doc_id", near, tie_col="tie").withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    start = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third)
    rows = rows.withColumn("edited", F.concat(start, F.substring("next_text", F.lit(1), third)))
    rows = syncmers.with_anchors(rows.drop("text", "next_text"), "edited", "edited_anchors")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.as_text(F.col("anchors")).alias("fingerprint"),
        syncmers.as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        syncmers.likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        syncmers.likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back: one row a record."""
    manifest = warc.archive(table(spark, sf_dir, "pages"))
    chunks = warc.read_warc(manifest, with_data=False)
    return chunks.filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: What the mixing query asks for: shares of all tokens by domain.
TARGET_SHARES = {"clean": 0.97, "low": 0.02, "toxic": 0.01}


def label_domains(labels: DataFrame) -> DataFrame:
    """The labelled table's domains: toxic, else low quality, else clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rate and copies of every document for the target shares."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    model = mixing.fit_domains(docs, label_domains(table(spark, sf_dir, "labels")))
    scored = written(mixing.score(docs, model), "mix-scored")
    tokens = scored.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    mix = mixing.fit_rates(scored, [TARGET_SHARES.get(d, 0.0) * tokens for d in model.domains])
    return mixing.with_rates(scored, mix, dead_band=0.0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents, one of them sent twice.

    All documents are inserted with word counts; all are inserted again under a
    tokenizer's version; word counts are revised to words and sentence marks;
    later copies of equal texts are deleted under both versions.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = TokenRollup(spark, fresh_path(spark, "rollup"))
    words = count_tokens(docs, "words-1")
    pieces = written(count_tokens(docs, "word-bpe-49k", tokenizer_path()), "rollup-pieces")
    marks = F.size(F.split(F.coalesce("text", F.lit("")), r"[.!?]+", -1)).cast("long") - 1
    revised = docs.select(
        F.lit("revise").alias("op"), "doc_id", "source", "lang", F.lit("words-1").alias("tokenizer"),
        (F.size(words_of(squeezed(F.col("text")))) + marks).alias("tokens"),
    )
    digest = docs.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    first = digest.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = digest.join(first, "digest").filter("doc_id > first")
    version = F.explode(F.array(F.lit("words-1"), F.lit("word-bpe-49k"))).alias("tokenizer")
    deleted = later.select(F.lit("delete").alias("op"), "doc_id", "source", "lang", version, F.lit(0).alias("tokens"))
    rollup.commit("words", words)
    rollup.commit("pieces", pieces)
    rollup.commit("revision", revised)
    rollup.commit("copies", deleted)
    rollup.commit("pieces", pieces)  # sent again: no effect
    return rollup.totals()


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that also start earlier."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "spans")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens: one row a piece."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset", "sequence_length")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices that each document contains."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid embedding on the first 16 whitened components: one row a component."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit_whitening(rows, "embedding")
    out = whitening.whiten(rows, "embedding", model)
    shares = F.array(*[F.lit(float(s)) for s in model.explained]) if model else F.array().cast("array<double>")
    each = out.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the bytes that they decode to."""
    path, pattern = byte_bpe.vocabulary_file()
    coded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    counted = coded.withColumn("n_tokens", F.size("ids").cast("long"))
    back = byte_bpe.decode(counted, byte_bpe.token_table(spark, path), digest_col="ids_sha256")
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_ngram_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS h FROM d
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL
  ) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)
), e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
r(s, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT s AS doc_id, min(v) AS component_id FROM r GROUP BY s) c USING (doc_id)""",
        "op5_warc": """
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages))""",
        "op12_lexical_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (
  SELECT k, t, count(*) AS tf, any_value(m) AS m FROM (
    SELECT k, unnest(w) AS t, 50 + (50 * len(w) * c.n) // c.l AS m FROM d, c
  ) GROUP BY k, t
), g AS (
  SELECT t, floor(1000 * ln((2 * any_value(c.n) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY t
), i AS (
  SELECT q, item_id, unnest(list_distinct(w)) AS t FROM (
    SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark)
), s AS (
  SELECT q, item_id, k, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM i JOIN g USING (t) JOIN p USING (t) GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM s JOIN d USING (k) WHERE score > 0
) WHERE rank <= 50""",
        "op2_line_dedup": r"""
WITH pages AS (
  SELECT row_number() OVER () AS k, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), boiler AS (
  SELECT source, line FROM (
    SELECT source, line, count(*) AS n FROM (
      SELECT DISTINCT k, source, unnest(lines) AS line FROM pages WHERE source IS NOT NULL
    ) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line
  ) JOIN (SELECT source, count(*) AS total FROM documents GROUP BY source) USING (source)
  WHERE n >= 3 AND n > 0.1 * total
), bad AS (SELECT source, list(line) AS bad FROM boiler GROUP BY source)
SELECT doc_id, source,
  CASE WHEN bad IS NULL OR text IS NULL THEN text
       ELSE array_to_string(list_filter(lines, lambda x: NOT list_contains(bad, x)), chr(10)) END AS text,
  CASE WHEN bad IS NULL OR text IS NULL THEN 0
       ELSE len(lines) - len(list_filter(lines, lambda x: NOT list_contains(bad, x))) END::BIGINT AS n_dropped_lines
FROM pages LEFT JOIN bad USING (source)""",
    }
