"""Embedding whitening from exact integer cross-products.

Entries become integers ``x = floor(scale * c) + offset``.  The fit list is
each distinct ``x`` vector once.  Its scatter is *bit-sliced*: every dimension
is shifted by its smallest value, the bits of equal weight of many rows are
packed into 64-bit words (a plane), and the weighted popcounts of the ANDs of
two dimensions' planes add up to their exact cross-product.  Sums, products
and the centring ``n * sum(x_i * x_j) - S_i * S_j`` are integers of any size;
only the centred matrix becomes doubles, for ``eigh``.

Work: one shuffle for the distinct vectors (equal ones meet in the map-side
aggregate, so a vector that a third of the rows share is one row a task), then
passes without one.  A task holds ``BLOCK`` rows and its own sums; what
tasks send on and the driver gets is of the size dimensions x dimensions
whatever the number of rows.

Defined results: a row whose vector is NULL or empty, holds a NULL or a
non-finite entry, or has another length than most vectors have (of equally
frequent lengths the longest counts) is dropped.  Equal vectors, NULL and
repeated ids keep their rows.  A component whose eigenvalue is 0 to double
precision does not exist, so equal vectors, a single row or an empty table
give no component.  Columns of the input that are named like a result are
replaced.  An entry beyond 64-bit integers is an arithmetic error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoframe.llm.common import drop_columns, own_name, quoted, ship_package, written

#: Rows whose bits are packed at a time (64 to a word).
BLOCK = 4096
#: Cross-products are summed in limbs of so many bits.
LIMB = 32


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: integer sums, and components by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    #: one row a component: the unit eigenvector over the square root of its eigenvalue
    weights: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    #: largest absolute entry of the whitened fit list's covariance minus the identity
    identity_error: float


def integers(vector: Column, scale: int = 64, offset: int = 1_000_000) -> Column:
    """``floor(scale * c) + offset`` of every entry, as longs; NULL for a vector that is to be dropped."""
    finite = F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    )
    x = F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(offset).cast("long"))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & finite, x)


def _matrices(batches: Iterator[pa.RecordBatch], column: str, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
            yield batch, flat.reshape(batch.num_rows, dims)


def _range_task(dims: int):
    def task(batches):
        low = high = None
        for _, x in _matrices(batches, "x", dims):
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if low is not None:
            yield pa.RecordBatch.from_pydict({"low": [low.tolist()], "high": [high.tolist()]})

    return task


def planes(y: np.ndarray, widths: list[int]) -> np.ndarray:
    """The bits of the rows of ``y`` (non-negative), one line of 64-bit words for each dimension and bit."""
    words = -(-len(y) // 64)
    out = np.zeros((sum(widths), 8 * words), np.uint8)
    k = 0
    for d, width in enumerate(widths):
        for b in range(width):
            bits = np.packbits(((y[:, d] >> b) & 1).astype(np.uint8))
            out[k, : len(bits)] = bits
            k += 1
    return out.view(np.uint64)


def scatter(packed: np.ndarray, widths: list[int]) -> np.ndarray:
    """Cross-products of the dimensions, upper triangle, in limbs: ``out[limb, i, j]``."""
    dims = len(widths)
    of = np.repeat(np.arange(dims), widths)
    weight = np.concatenate([np.arange(w) for w in widths]) if dims else np.zeros(0, int)
    limbs = 2 * max(widths, default=0) // LIMB + 1
    out = np.zeros((limbs, dims, dims), np.int64)
    first = np.concatenate([[0], np.cumsum(widths)])
    for p in range(len(packed)):
        start = int(first[of[p]])  # all planes of the own dimension and of the later ones
        counts = np.bitwise_count(packed[p] & packed[start:]).sum(1, dtype=np.int64)
        power = weight[p] + weight[start:]
        for limb in range(limbs):
            here = power // LIMB == limb
            if here.any():
                np.add.at(out[limb, of[p]], of[start:][here], counts[here] << (power[here] % LIMB))
    return out


def _scatter_task(low: list[int], widths: list[int]):
    dims = len(low)
    shift = np.array(low, np.int64)

    def task(batches):
        total, n, sums, waiting, held = None, 0, np.zeros(dims, object), [], 0

        def flush(total, rows):
            part = scatter(planes(rows, widths), widths)
            return part if total is None else total + part

        for _, x in _matrices(batches, "x", dims):
            y = x - shift
            n, sums = n + len(y), sums + y.sum(0).astype(object)
            waiting, held = [*waiting, y], held + len(y)
            if held >= BLOCK:
                rows = np.concatenate(waiting)
                whole = held - held % BLOCK
                for at in range(0, whole, BLOCK):
                    total = flush(total, rows[at : at + BLOCK])
                waiting, held = [rows[whole:]], held - whole
        if held:
            total = flush(total, np.concatenate(waiting))
        if total is None:
            return
        # limb -1: the number of rows and the sums
        yield pa.RecordBatch.from_pydict({"i": [-1], "limb": [-1], "part": [[n, *map(int, sums)]]})
        for limb in range(len(total)):
            for i in range(dims):
                yield pa.RecordBatch.from_pydict({"i": [i], "limb": [limb], "part": [total[limb, i].tolist()]})

    return task


def centred_products(fit: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """``n``, the sums ``S``, and ``n * sum(x_i * x_j) - S_i * S_j``, exact integers, of the column ``x``."""
    ranges = fit.mapInArrow(_range_task(dims), "low array<long>, high array<long>")
    each = ranges.select(F.posexplode(F.arrays_zip("low", "high")).alias("d", "r"))
    found = each.groupBy("d").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high")).collect()
    low, high = [0] * dims, [0] * dims
    for r in found:
        low[r["d"]], high[r["d"]] = r["low"], r["high"]
    widths = [(b - a).bit_length() for a, b in zip(low, high, strict=True)]
    parts = fit.mapInArrow(_scatter_task(low, widths), "i long, limb long, part array<long>")
    each = parts.select("i", "limb", F.posexplode("part").alias("j", "v"))
    # one row a pair of dimensions and limb
    totals = each.groupBy("i", "limb", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    n, shifted, products = 0, [0] * dims, [[0] * dims for _ in range(dims)]
    for r in totals:
        v = int(r["v"])
        if r["limb"] < 0:
            if r["j"]:
                shifted[r["j"] - 1] = v
            else:
                n = v
        elif r["j"] >= r["i"]:
            products[r["i"]][r["j"]] += v << (LIMB * r["limb"])
    centred = [[0] * dims for _ in range(dims)]
    for i in range(dims):
        for j in range(i, dims):  # a shift of a dimension leaves its centred products as they are
            centred[i][j] = centred[j][i] = n * products[i][j] - shifted[i] * shifted[j]
    return n, [s + n * a for s, a in zip(shifted, low, strict=True)], centred


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``n * x - S``: 64-bit integers where they fit, else Python's."""
    most = max(n * max(abs(int(x.min())), abs(int(x.max()))), *map(abs, sums))
    if 2 * most < 2**63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _project(deviation: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    return (deviation.astype(np.float64) / n) @ weights.T


def _moment_task(n: int, sums: tuple[int, ...], weights: np.ndarray):
    def task(batches):
        total, mean = 0.0, 0.0
        for _, x in _matrices(batches, "x", len(sums)):
            w = _project(_deviations(x, n, sums), n, weights)
            total, mean = total + w.T @ w, mean + w.sum(0)
        if np.ndim(total):
            yield pa.RecordBatch.from_pydict({"part": [[*total.ravel().tolist(), *mean.tolist()]]})

    return task


def fit_whitening(rows: DataFrame, vector_col: str, components: int = 16, scale: int = 64, offset: int = 1_000_000) -> Whitening | None:
    """Fit on each distinct integer vector once; None for a table without valid vectors."""
    ship_package(rows.sparkSession)
    x = integers(F.col(quoted(vector_col)), scale, offset)
    valid = rows.select(x.alias("x")).where(F.col("x").isNotNull())
    lengths = valid.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return None
    dims = most["dims"]
    fit = written(valid.where(F.size("x") == dims).distinct(), "whitening-fit")
    n, sums, centred = centred_products(fit, dims)
    covariance = np.array([[c / (n * n) for c in row] for row in centred])
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    floor = dims * np.finfo(float).eps * max(values.max(), 0.0)
    order = order[values[order] > floor]
    values_kept = values[order]
    weights = vectors[:, order].T / np.sqrt(values_kept)[:, None]
    trace = sum(centred[i][i] for i in range(dims)) / (n * n)
    error = 0.0
    if len(order):
        k = len(order)
        parts = fit.mapInArrow(_moment_task(n, tuple(sums), weights), "part array<double>")
        each = parts.select(F.posexplode("part").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
        moments = np.array([r["v"] for r in sorted(each.collect())]) / n
        mean = moments[k * k :]
        error = float(np.abs(moments[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    return Whitening(n, tuple(sums), weights, values_kept, values_kept / trace if trace else values_kept, error)


def whiten(rows: DataFrame, vector_col: str, model: Whitening | None, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """The valid rows with ``deviation decimal(38,0)`` and ``whitened array<double>`` (an entry a component).

    ``deviation`` is the exact sum over dimensions of ``(n * x - S) ** 2``.
    """
    ship_package(rows.sparkSession)
    dims = len(model.sums) if model else -1
    x = own_name(rows, "_x")
    valid = rows.withColumn(x, integers(F.col(quoted(vector_col)), scale, offset)).where(F.size(x) == dims)
    valid = drop_columns(valid, ["deviation", "whitened"])
    kept = [f for f in valid.schema.fields if f.name != x]
    out = valid.select(*[F.col(quoted(f.name)) for f in kept], F.col(x))
    schema = ", ".join([*(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in kept), "deviation string", "whitened array<double>"])
    if model is None:
        empty = out.withColumns({"deviation": F.lit("0"), "whitened": F.array().cast("array<double>")}).drop(x)
        return empty.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
    n, sums, weights = model.n, model.sums, model.weights

    def task(batches):
        for batch, entries in _matrices(batches, x, dims):
            deviation = _deviations(entries, n, sums)
            if deviation.dtype == object or dims * float(np.abs(deviation).max()) ** 2 >= 2**62:
                squares = (deviation.astype(object) ** 2).sum(1).tolist()
            else:
                squares = (deviation * deviation).sum(1).tolist()
            w = _project(deviation, n, weights)
            ends = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = [*batch.schema.names[:-1], "deviation", "whitened"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(map(str, squares))), lists], names)

    done = out.mapInArrow(task, schema)
    return done.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
