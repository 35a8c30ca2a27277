"""Mixing documents to target weights by soft domain membership.

A softmax classifier, fitted on a bounded sample of a labelled table, gives
every document its posterior over the domains.  Rates per document,
``low <= rate <= high``, then minimize

    1/2 sum_d (sum_i p_id t_i r_i - target_d)^2 / own_d + ridge/2 sum_i t_i (r_i - 1)^2

with tokens ``t``, posteriors ``p`` and each domain's own tokens at rate 1,
``own_d = sum_i p_id t_i``.  A miss counts relative to the domain's own tokens,
so a domain of a thousandth of all tokens is fitted like one of a tenth.

The fit is projected gradient descent (accelerated, with restarts):
``r <- clip(y - step * g, low, high)`` with the gradient scaled by each document's
tokens, ``g_i = sum_d p_id (total_d - target_d) / own_d + ridge (y_i - 1)``.  In that
scale its slope is at most ``1 + ridge`` whatever the data, which gives the step.
A step is one Spark aggregate of a few numbers a domain.  No rate is stored:
a document's rate is replayed from the list of past domain residuals.  The fit
ends by the projected gradient, measured for each domain against its own
tokens; it raises an error rather than return an unfinished answer.  Nothing is
joined or shuffled by domain or source, so neither can be hot.

Rates become copies by carried rounding: within strata (a document's likeliest
domain, cut to groups of bounded size) documents are taken by falling length,
each is rounded so that the tokens rounded off so far stay least, and what is
left over is carried on.  A stratum so misses its tokens by about its shortest
document, and a few long ones do not decide a rare domain.  A rate within
``dead_band`` of 1 becomes 1.

Defined results: a NULL text counts as empty and has 0 tokens; its rate is
what its posterior gives, and its copies are that rounded.  Repeated rows have
the same rate, and each its own copies.  Without labelled rows there are no
domains: nothing is fitted and every rate is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoframe.llm.common import drop_columns, own_name, quoted, ship_package, written

#: What the classifier looks at besides words: length, variety, and shares of bytes.
N_SHAPES = 6
_SYMBOLS, _UPPER = b"#*$%&|<>", bytes(range(65, 91))
_PLAIN = {ord(c): " " for c in ".,!?;:"}


def text_features(texts: list[str], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Presence of words and shapes of whole texts; and their numbers of words."""
    out, tokens = np.zeros((len(texts), len(index) + N_SHAPES)), np.zeros(len(texts), np.int64)
    wanted = index.keys()
    for i, text in enumerate(texts):
        tokens[i] = len(text.split())
        words = text.lower().translate(_PLAIN).split()
        seen = set(words)
        for w in wanted & seen:
            out[i, index[w]] = 1.0
        data = text.encode()
        size = max(1, len(data))
        out[i, len(index) :] = (
            np.log1p(len(words)),
            len(seen) / max(1, len(words)),
            (len(data) - len(data.translate(None, _SYMBOLS))) / size,
            (len(data) - len(data.translate(None, _UPPER))) / size,
            data.count(b"!") / size,
            data.count(b"\n") / size,
        )
    return out, tokens


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class DomainModel:
    """Softmax weights over word presence and text shapes."""

    domains: tuple[str, ...]
    words: tuple[str, ...]
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (features + 1) x domains

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        if not self.domains:
            return np.zeros((len(x), 0))
        return _softmax(np.c_[(x - self.centre) / self.scale, np.ones(len(x))] @ self.weights)


def fit_softmax(x: np.ndarray, y: np.ndarray, n_classes: int, ridge: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Weights by accelerated gradient descent on the mean log loss plus a ridge."""
    x = np.c_[x, np.ones(len(x))]
    target = np.eye(n_classes)[y]
    rate = 1.0 / (0.5 * np.linalg.norm(x.T @ x / len(x), 2) + ridge)
    w = ahead = np.zeros((x.shape[1], n_classes))
    for k in range(steps):
        gradient = x.T @ (_softmax(x @ ahead) - target) / len(x) + ridge * ahead
        new = ahead - rate * gradient
        ahead, w = new + k / (k + 3) * (new - w), new
    return w


def fit_domains(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_fit: int = 12_000,
    n_words: int = 256,
) -> DomainModel:
    """Fit on ``labels`` (``id_col``, ``domain``): at most ``max_fit`` labelled rows, chosen by hash of the id.

    That many rows of ``n_words`` + 6 numbers come to the driver, never texts.
    Words are those whose document shares differ most between domains.
    """
    marks = labels.select(F.col(quoted(id_col)).alias("i"), F.col("domain").cast("string").alias("domain"))
    marks = marks.filter("i IS NOT NULL AND domain IS NOT NULL").orderBy(F.xxhash64("i"), "i", "domain").limit(max_fit)
    texts = docs.select(F.col(quoted(id_col)).alias("i"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("t"))
    sample = written(texts.join(written(marks, "mix-marks"), "i").limit(max_fit), "mix-sample")
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = tuple(sorted(sizes))
    if not domains:
        return DomainModel((), (), np.zeros(N_SHAPES), np.ones(N_SHAPES), np.zeros((N_SHAPES + 1, 0)))
    plain = F.regexp_replace(F.lower("t"), "[.,!?;:]", " ")
    shown = sample.select("domain", F.explode(F.array_distinct(F.split(plain, r"\s+"))).alias("w")).filter("w <> ''")
    counts = shown.groupBy("w").agg(
        F.count("*").alias("n"), *[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{k}") for k, d in enumerate(domains)]
    )
    total = sum(sizes.values())
    # squared distance of the observed from the expected counts, in units of their variance
    strength = sum(
        (F.col(f"n{k}") - F.col("n") * sizes[d] / total) ** 2 / (F.col("n") * sizes[d] / total + 1)
        for k, d in enumerate(domains)
    )
    chosen = counts.filter("n >= 3").orderBy(strength.desc(), "w").limit(n_words).select("w")
    words = tuple(r["w"] for r in chosen.collect())
    index = {w: i for i, w in enumerate(words)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x, _ = text_features(rows.column(1).to_pylist(), index)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(list(x.astype("f4")))], ["domain", "x"])

    rows = sample.select("domain", "t").mapInArrow(features, "domain string, x array<float>").toArrow()
    x = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(rows.num_rows, -1).astype(float)
    y = np.array([domains.index(d) for d in rows.column("domain").to_pylist()])
    order = np.lexsort((*x.T[-3:], y))  # rows come in any order; sums should not depend on it
    x, y = x[order], y[order]
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    scale[: len(words)] = np.maximum(scale[: len(words)], 0.05)
    return DomainModel(domains, words, centre, scale, fit_softmax((x - centre) / scale, y, len(domains)))


def score(docs: DataFrame, model: DomainModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``tokens`` (words) and ``posteriors`` (array of double, as ``model.domains``)."""
    ship_package(docs.sparkSession)
    keep = drop_columns(docs, ["tokens", "posteriors"])
    others = [c for c in keep.columns if c != text_col]
    texts = keep.select(*[F.col(quoted(c)) for c in others], F.col(quoted(text_col)).alias("_text_"))
    plain = keep.select(*[F.col(quoted(c)) for c in others])
    schema = T.StructType([*plain.schema, T.StructField("tokens", T.LongType()), T.StructField("posteriors", T.ArrayType(T.DoubleType()))])
    index = {w: i for i, w in enumerate(model.words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 1000):
                part = rows.slice(at, 1000)
                x, tokens = text_features([t or "" for t in part.column(part.num_columns - 1).to_pylist()], index)
                p = model.posteriors(x)
                columns = [*part.columns[:-1], pa.array(tokens), pa.array(list(p), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, [*others, "tokens", "posteriors"])

    return texts.mapInArrow(run, schema)


@dataclass(frozen=True)
class Mix:
    """What documents' rates follow from: the steps of the descent."""

    #: per step the domains' residuals over their own tokens, and how far the step's direction is followed on
    steps: tuple[tuple[tuple[float, ...], float], ...]
    ridge: float
    low: float
    high: float
    #: tokens by domain at the fitted rates
    totals: tuple[float, ...]

    def rates(self, posteriors: np.ndarray) -> np.ndarray:
        """One rate a row of ``posteriors``."""
        return _replay(posteriors, self.steps, self.ridge, self.low, self.high)[0]


def _replay(p: np.ndarray, steps, ridge: float, low: float, high: float):
    """Rates after some steps, where the next one starts, and the last step's move and its slope."""
    rate = start = np.clip(np.ones(len(p)), low, high)
    moved = slope = np.zeros(len(p))
    for residual, onward in steps:
        gradient = p @ np.array(residual) + ridge * (start - 1.0) if len(residual) else np.zeros(len(p))
        new = np.clip(start - gradient / (1.0 + ridge), low, high)
        moved, slope = np.abs(new - start), gradient * (new - rate)
        start, rate = new + onward * (new - rate), new
    return rate, start, moved, slope


#: Steps after which a fit that has not ended is an error.
MAX_STEPS = 2000


def fit_rates(
    scored: DataFrame,
    targets: list[float],
    ridge: float = 1e-3,
    low: float = 0.0,
    high: float = 4.0,
    tolerance: float = 3e-4,
) -> Mix:
    """Projected gradient descent on ``tokens`` and ``posteriors``; one aggregate a step.

    ``targets``: wanted tokens per domain.  Ends when a step moves at most
    ``tolerance`` of each domain's own tokens, and no rate by more than that.
    """
    n = len(targets)
    if not n:
        return Mix((), ridge, low, high, ())
    rows = scored.select("tokens", "posteriors").filter("tokens > 0")
    wanted = np.array(targets, float)

    def measured(steps) -> np.ndarray:
        """By domain: own tokens, tokens at the next start, at the rates, moved last; the last slope; the farthest move."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((6, n))
            for batch in batches:
                t = batch.column(0).to_numpy().astype(float)
                p = np.asarray(batch.column(1).flatten()).reshape(len(t), n)
                rate, start, moved, slope = _replay(p, steps, ridge, low, high)
                out[:5] += np.vstack([t @ p, (t * start) @ p, (t * rate) @ p, (t * moved) @ p, np.full(n, t @ slope)])
                out[5] = np.maximum(out[5], moved.max(initial=0.0))
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel()], pa.list_(pa.float64()))], ["x"])

        # fixed-point sums, so that the order in which tasks end makes no difference
        each = rows.mapInArrow(sums, "x array<double>").select(F.posexplode("x").alias("k", "v"))
        found = each.groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,9)")).alias("v"), F.max("v").alias("m")).collect()
        out = np.zeros(6 * n)
        for r in found:
            out[r["k"]] = float(r["v"]) if r["k"] < 5 * n else r["m"]
        return out.reshape(6, n)

    steps: list[tuple[tuple[float, ...], float]] = []
    since = 0  # steps since the acceleration began anew
    while True:
        own, ahead, totals, moved, slope, farthest = measured(tuple(steps))
        there = own > 0
        scale = np.where(there, own, 1.0)
        if steps and np.all(moved <= tolerance * scale) and farthest[0] <= tolerance:
            return Mix(tuple(steps), ridge, low, high, tuple(map(float, totals)))
        if len(steps) >= MAX_STEPS:
            raise RuntimeError(f"mixing rates are not optimal after {MAX_STEPS} steps")
        since = 0 if slope[0] > 0 else since + 1
        residual = np.where(there, (ahead - wanted) / scale, 0.0)
        steps.append((tuple(map(float, residual)), since / (since + 3.0)))


#: Rows of a group whose copies are rounded together.
GROUP_ROWS = 50_000


def _rounded(tokens: np.ndarray, rates: np.ndarray, dead_band: float) -> np.ndarray:
    """Copies of documents in falling order of length: what is rounded off is carried on."""
    copies = np.round(rates).astype(np.int64)
    whole = np.floor(rates)
    # what is near a whole number is that; so are empty texts
    open_ = (np.abs(rates - copies) > dead_band) & (tokens > 0)
    carried = 0.0
    for i in np.flatnonzero(open_).tolist():
        exact = tokens[i] * (rates[i] - whole[i])
        up = carried + exact >= tokens[i] / 2
        copies[i] = int(whole[i]) + up
        carried += exact - (tokens[i] if up else 0)
    return copies


def with_rates(scored: DataFrame, mix: Mix, dead_band: float = 0.05) -> DataFrame:
    """``scored`` with ``rate`` (double) and ``copies`` (long)."""
    keep = drop_columns(scored, ["rate", "copies"])
    spark = scored.sparkSession
    shared = spark.sparkContext.broadcast(mix)

    @F.pandas_udf("double")
    def rate_of(p: pd.Series) -> pd.Series:
        return pd.Series(shared.value.rates(np.stack(p.to_numpy())) if len(p) else [], dtype="float64")

    domain, group = own_name(keep, "_domain"), own_name(keep, "_group")
    likeliest = F.coalesce(F.array_position("posteriors", F.array_max("posteriors")), F.lit(0))
    rated = written(keep.withColumns({"rate": F.round(rate_of("posteriors"), 6), domain: likeliest}), "mix-rates")
    sizes = {r[domain]: r["n"] for r in rated.groupBy(domain).agg(F.count("*").alias("n")).collect()}  # a row a domain
    groups = F.coalesce(*[F.when(F.col(domain) == d, F.lit(-(-n // GROUP_ROWS))) for d, n in sizes.items()], F.lit(1))
    # the row's number in the written table, so that equal rows part, too
    dealt = rated.withColumn(group, F.pmod(F.xxhash64(F.monotonically_increasing_id()), groups))
    names = [*keep.columns, "rate", "copies"]

    def round_group(rows: pa.Table) -> pa.Table:
        tokens, rates = (rows.column(c).to_numpy().astype(float) for c in ("tokens", "rate"))
        order = np.lexsort((rates, -tokens))
        copies = np.empty(len(order), np.int64)
        copies[order] = _rounded(tokens[order], rates[order], dead_band)
        return rows.select(names[:-1]).append_column("copies", pa.array(copies))

    schema = T.StructType([*rated.select(*[quoted(c) for c in names[:-1]]).schema, T.StructField("copies", T.LongType())])
    return dealt.groupBy(domain, group).applyInArrow(round_group, schema)
