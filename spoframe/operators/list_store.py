"""List values in chunks: ``(s, p, chunk, values, counts)`` (E5, E6, H1, A5 for multi-valued predicates).

A chunk holds about ``chunk_values`` values of one subject and predicate.  A
subject with more values has several chunks, cut by a hash of the value, and
is built by as many tasks: no task and no row holds a whole hub subject.

* Equal triples are counted first (map-side combined): ``counts[i]`` is how
  often ``values[i]`` occurs, so a value repeated without end is one entry.
* Only pairs ``(s, p)`` with more rows than ``chunk_values`` are listed with
  their number of chunks; there are at most ``rows / chunk_values`` of them.
  They are looked up under a salt from the value's hash, so the rows of a hub
  spread over ``SALTS`` tasks there, too.
* The rows are dealt by ``(s, p, chunk)`` explicitly: grouping on what the
  lookup was dealt by would bring a whole hub back into one task.

Predicates that are known (from statistics) to have no long list need no lookup:
their rows are dealt by ``(s, p)`` once.  The rows of the result are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoframe.sources.layouts import only_predicates

#: Values of one chunk, on average, of a long list.
CHUNK_VALUES = 1000
#: Ways that the rows of one pair are spread in the lookup of its chunks.
SALTS = 64


def value_chunk(value: Column, chunks: Column) -> Column:
    """The chunk of a value in a list of ``chunks`` chunks: 32 bits of its MD5, modulo ``chunks``."""
    bits = F.conv(F.substring(F.md5(value.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.when(chunks > 1, F.pmod(bits, chunks)).otherwise(F.lit(0).cast("bigint"))


def list_chunks(
    triples: DataFrame,
    predicates: list[str] | None = None,
    chunk_values: int = CHUNK_VALUES,
    short: list[str] | tuple[str, ...] = (),
    tasks: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """``(s, p, chunk, values, counts)`` of the given predicates (default: all); values are sorted and distinct.

    ``short``: predicates of which no subject has more than ``chunk_values`` rows.
    ``tasks``: the width of the shuffle that builds the lists (default: as the session says).
    ``buckets``: the triples are a table with so many buckets by subject, and the lists
    lie by subject as well: short ones are built where their rows lie, long ones, which
    are cut over all tasks, are dealt back once they are chunks.
    """
    if chunk_values < 1:
        raise ValueError("chunk_values must be positive")
    rows = triples if predicates is None else only_predicates(triples, predicates)
    back = lambda lists: lists if buckets is None else lists.repartition(buckets, "s")
    if not short:
        return back(_long_lists(rows.select("s", "p", "o"), chunk_values, tasks))
    known = only_predicates(rows, list(short)).select("s", "p", F.lit(0).cast("bigint").alias("chunk"), "o")
    whole = _gathered(_dealt(known, tasks, "s", "p") if buckets is None else known)
    if predicates is not None and set(predicates) <= set(short):
        return whole
    others = rows.where(~F.col("p").isin(list(short)))
    if predicates is not None:
        others = only_predicates(triples, [p for p in predicates if p not in set(short)])
    return whole.unionByName(back(_long_lists(others.select("s", "p", "o"), chunk_values, tasks)))


def _dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    return rows.repartition(*keys) if tasks is None else rows.repartition(tasks, *keys)


def _gathered(dealt: DataFrame) -> DataFrame:
    """Chunks from rows (s, p, chunk, o) that lie together; counts are made on the spot."""
    values = dealt.groupBy("s", "p", "chunk", "o").agg(F.count(F.lit(1)).alias("k"))
    return _chunks(values)


def _chunks(values: DataFrame) -> DataFrame:
    lists = values.groupBy("s", "p", "chunk").agg(F.sort_array(F.collect_list(F.struct("o", "k"))).alias("v"))
    return lists.select("s", "p", "chunk", F.col("v.o").alias("values"), F.col("v.k").alias("counts"))


def _long_lists(rows: DataFrame, chunk_values: int, tasks: int | None = None) -> DataFrame:
    sizes = rows.groupBy("s", "p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk_values)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    long_lists = sizes.select("s", "p", F.ceil(F.col("n") / chunk_values).alias("chunks"), salts)
    values = rows.groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("k"))
    salted = values.withColumn("salt", F.pmod(F.xxhash64("o"), F.lit(SALTS)).cast("int"))
    looked_up = salted.join(long_lists, ["s", "p", "salt"], "left")
    chunk = value_chunk(F.col("o"), F.coalesce("chunks", F.lit(1)))
    return _chunks(_dealt(looked_up.select("s", "p", chunk.alias("chunk"), "o", "k"), tasks, "s", "p", "chunk"))


def list_sizes(lists: DataFrame) -> DataFrame:
    """``(s, p, n)``: the number of rows (duplicates included) of each list."""
    rows = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, k: a + k)
    return lists.groupBy("s", "p").agg(F.sum(rows).alias("n"))


def list_values(lists: DataFrame, p: str) -> DataFrame:
    """``(s, o)``: the distinct values of one predicate."""
    return only_predicates(lists, [p]).select("s", F.explode("values").alias("o"))
