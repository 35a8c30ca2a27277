"""Document fingerprints of closed syncmers (DataFrame functions only).

A run of ``k`` words is a closed syncmer when the smallest hash among its runs
of ``s`` words is the first or the last of them.  Whether it is one depends on
its own words alone, so an edit moves or removes only the anchors that touch
it.  A fingerprint keeps the ``size`` anchors with the smallest hashes, each
as 40 bits of hash and 24 bits of word position (16 hexadecimal digits).

Likeness estimates the share of common anchors (bottom-k: for texts with more
than ``size`` anchors the standard error is ``sqrt(j * (1 - j) / size)``, 0.0625 at
most; texts with fewer are compared by all of them) and counts an anchor
only if its shift between the two texts is near the median shift of the common
anchors, so the same phrases in another order do not count.

Defined results: a NULL text counts as empty; texts of fewer than ``k`` words
and longer ones without a closed syncmer (short ones can have none) have one
anchor, the hash of all their words; a text without words has none; two texts without anchors have likeness 1, one against none 0.  Positions
beyond 2^24 - 1 count as that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoframe.llm.common import drop_columns, own_name, quoted, shifted, squeezed, words_of, written

POSITION_BITS = 24
_MASK = (1 << POSITION_BITS) - 1


def with_anchors(df: DataFrame, text_col: str, out: str, k: int = 5, s: int = 2, size: int = 64) -> DataFrame:
    """``df`` with ``out``: the packed anchors (array of long, in order of hash)."""
    if not 1 <= s < k:
        raise ValueError("s must be at least 1 and below k")
    keep = drop_columns(df, [out])
    words, small, whole, least, closed, packed = (
        own_name(keep, n) for n in ("_words", "_small", "_whole", "_least", "_closed", "_packed")
    )
    c = F.col
    pair = lambda a, b: F.xxhash64(a, b)
    step = keep.withColumn(words, words_of(squeezed(F.coalesce(c(quoted(text_col)), F.lit("")))))
    step = step.withColumn(words, F.transform(c(words), lambda w: F.xxhash64(w)))
    step = step.withColumn(small, c(words))
    for j in range(1, s):
        step = step.withColumn(small, F.zip_with(c(small), shifted(c(words), j), pair))
    step = step.withColumn(whole, c(small))
    for j in range(s, k):
        step = step.withColumn(whole, F.zip_with(c(whole), shifted(c(words), j), pair))
    span = k - s  # a run of k words has span + 1 runs of s words
    smaller = lambda a, b: F.least(a, b)
    step = step.withColumn(least, c(small))
    for j in range(1, span + 1):
        step = step.withColumn(least, F.zip_with(c(least), shifted(c(small), j), smaller))
    n_runs = F.size(c(words)) - (k - 1)
    edges = F.zip_with(c(small), shifted(c(small), span), smaller)
    step = step.withColumn(closed, F.zip_with(edges, c(least), lambda e, m: e == m))
    high = F.zip_with(c(whole), c(closed), lambda h, ok: F.when(ok, h.bitwiseAND(F.lit(~_MASK))))
    anchors = F.filter(
        F.transform(
            F.slice(high, F.lit(1), F.greatest(n_runs, F.lit(0))),
            lambda h, i: h.bitwiseOR(F.least(i, F.lit(_MASK)).cast("long")),
        ),
        lambda x: x.isNotNull(),
    )
    only = F.array(F.xxhash64(c(words)).bitwiseAND(F.lit(~_MASK)))
    none = F.array().cast("array<long>")
    step = step.withColumn(
        packed,
        F.when(F.size(c(words)) == 0, none).when(n_runs < 1, only).otherwise(F.sort_array(anchors)),
    )
    # no run of a short text need be closed; only texts without words have no anchor
    step = step.withColumn(packed, F.when((F.size(c(packed)) == 0) & (n_runs >= 1), only).otherwise(c(packed)))
    hash_of = lambda x: F.shiftright(x, POSITION_BITS)
    # equal hashes are neighbours, the earliest position first: keep that one
    first = F.filter(
        c(packed), lambda x, i: (i == 0) | (hash_of(x) != hash_of(F.get(c(packed), F.greatest(i - 1, F.lit(0)))))
    )
    step = step.withColumn(out, F.slice(first, 1, size))
    return step.select([F.col(quoted(x)) for x in keep.columns] + [out])


def as_text(anchors: Column) -> Column:
    """A fingerprint as a string: 16 hexadecimal digits an anchor."""
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column, size: int = 64) -> Column:
    """Share of common anchors, from 0 to 1, of two packed fingerprints."""
    hash_of = lambda x: F.shiftright(x, POSITION_BITS)
    place = lambda x: x.bitwiseAND(F.lit(_MASK))
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    hashes = lambda x: F.transform(x, hash_of)
    full = (F.size(a) >= size) | (F.size(b) >= size)
    union = F.sort_array(F.array_union(hashes(a), hashes(b)))
    seen = F.when(full, F.slice(union, 1, size)).otherwise(union)

    def matched(u: Column) -> Column:
        by_hash = F.map_from_entries(F.transform(b, lambda x: F.struct(hash_of(x).alias("h"), place(x).alias("p"))))
        common = lambda m: F.filter(
            F.transform(
                F.filter(a, lambda x: hash_of(x) <= F.element_at(u, -1)),
                lambda x: place(x) - F.try_element_at(m, hash_of(x)),
            ),
            lambda x: x.isNotNull(),
        )
        slack = F.lit(16) + F.array_max(F.transform(F.concat(a, b), place)) / 8
        near = lambda d: F.size(
            F.filter(d, lambda x: F.abs(x - F.get(F.sort_array(d), F.floor(F.size(d) / 2).cast("int"))) <= slack)
        )
        return let(let(by_hash, common), near) / F.size(u)

    nothing = (F.size(a) == 0) | (F.size(b) == 0)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when(nothing, F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .otherwise(let(seen, matched))
    )


def with_next(
    df: DataFrame, id_col: str, columns: dict[str, str], rows_per_bucket: int = 4000, tie_col: str | None = None
) -> DataFrame:
    """``df`` with the named columns of the next row in descending order of the id (the last: of the first).

    Rows are dealt to ranges of ids (quantiles, subdivided evenly) with one
    shuffle.  Each range also gets a copy of the first row of the next
    non-empty range, so no order over all rows is needed.  NULL ids come last;
    equal ids are ordered by ``tie_col``.
    """
    ident = F.col(quoted(id_col))
    tie = F.col(quoted(tie_col)) if tie_col else F.lit(0).cast("long")
    n = df.select(ident.alias("i")).agg(F.count("*").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi")).first()
    total = max(1, -(-n["n"] // rows_per_bucket))
    coarse = min(256, total)
    fine = -(-total // coarse)
    cuts = [n["lo"]] if n["lo"] is not None else []
    if cuts and coarse > 1:
        shares = [(i + 1) / coarse for i in range(coarse - 1)]
        found = df.select(ident.alias("i")).agg(F.percentile_approx("i", shares, 10_000).alias("c")).first()["c"]
        cuts = sorted({n["lo"], *found})
    # range j holds the ids from cuts[j] up to below cuts[j + 1], the last one up to the largest id
    if cuts:
        bounds = F.array(*[F.lit(x).cast("long") for x in cuts])
        at = F.size(F.filter(bounds, lambda x: x <= ident))
        # in doubles: differences of 64-bit ids may not fit in 64 bits
        low = F.get(bounds, at - 1).cast("double")
        high = F.coalesce(F.get(bounds, at), F.lit(n["hi"]).cast("long")).cast("double")
        within = F.floor((ident.cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * fine)
        number = at.cast("long") * fine + F.least(within, F.lit(fine - 1)).cast("long")
        number = F.when(ident.isNull(), F.lit(-1).cast("long")).otherwise(number)
    else:
        number = F.lit(-1).cast("long")
    bucket, ghost, order = (own_name(df, x) for x in ("_bucket", "_ghost", "_tie"))
    rows = df.withColumns({bucket: number, order: tie})
    key = F.struct(F.coalesce(ident, F.lit(-(1 << 63))).alias("i"), (-F.col(order)).alias("t"))
    firsts = rows.groupBy(F.col(bucket).alias("b")).agg(F.max(key).alias("k"))
    # one row a bucket: the bucket before it (in descending order) gets its first row
    w = Window.orderBy(F.desc("b"))
    wrap = F.max_by("b", -F.col("b")).over(Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.withColumn("to", F.coalesce(F.lag("b").over(w), wrap))
    firsts = written(firsts.select("b", "k.i", "k.t", "to"), "next-firsts")
    same = (F.col(bucket) == F.col("b")) & (F.coalesce(ident, F.lit(-(1 << 63))) == F.col("i")) & (-F.col(order) == F.col("t"))
    ghosts = rows.join(firsts, same).withColumns({bucket: F.col("to"), ghost: F.lit(True)})
    both = rows.withColumn(ghost, F.lit(False)).unionByName(ghosts.drop("b", "i", "t", "to"))
    order_by = Window.partitionBy(bucket).orderBy(ghost, ident.desc_nulls_last(), order)
    out = both.withColumns({new: F.lead(quoted(old)).over(order_by) for new, old in columns.items()})
    return out.filter(~F.col(ghost)).drop(bucket, ghost, order)
