"""N-gram Jaccard join as a blocked sparse product of the document by n-gram matrix.

The product of the incidence matrix with its transpose holds the overlap of
every two documents.  Only entries that can reach the threshold are worked
out, and every bound below is exact, so no link is lost:

1. Documents with equal sets become one row of the matrix (a class).
2. A quarter of the columns (by hash) is counted over all classes.  With the
   columns ordered by count, two linked classes share a column among the first
   ``n - ceil(t n) + 1`` of either (a bound by size).  Columns that one class
   has alone link nothing, so most classes have no entry left here.
3. What is left is a block per column.  A block first tries one of its rows
   against the others; rows found to belong together are then one group, and
   only pairs of different groups are tried from there on.
4. Blocks of up to ``narrow`` rows then try all such pairs, a bounded number a
   row.  Wider blocks that have rows in common are multiplied together: rows
   are dealt by size into classes of which only equal and neighbouring ones
   can link, each class into tiles, and a task multiplies two tiles,
   accumulates the overlaps of their rows and returns a spanning forest of the
   links.  A row is sent once a tile pair, never once a pair.
5. A pair is tried only if its sizes allow the threshold.  Its overlap is
   accumulated over the whole rows and compared exactly.

Columns are 64-bit hashes of n-grams.  Counting combines before the shuffle,
joins on a column are split by adaptive execution where one is hot, and
neither links nor classes come to the driver.

Defined results: NULL and empty texts have no n-grams and are linked with
nothing; a text of fewer than ``n`` words has one, all its words; documents
with a NULL id keep their row, link with nothing else and have a NULL
component; rows that repeat an id are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoframe.llm.common import own_name, quoted, ship_package, written, written_buckets
from spoframe.llm.components import connected_components
from spoframe.llm.hashing import mixed, word_hashes
from spoframe.llm.packed import pack_numbers, pack_words, unpack_numbers, unpack_words
from spoframe.llm.repeated import SENT, VALUE_BITS, bucket_count, occurrences, repeated_values, sent_rows, with_found

#: One column in so many is counted over all classes.
COUNTED = 4
#: Columns are named by the high bits of their n-grams' hashes: equal n-grams have equal columns, and different
#: ones with a column in common are only tried in vain.
COLUMN_SHIFT = 64 - VALUE_BITS
#: Documents and characters of a block of profiles.
BLOCK_DOCS, BLOCK_CHARS = 20_000, 6_000_000


def gram_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams (A-Z lower-cased)."""
    words = text.lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return np.zeros(0, np.int64)
    hashes = word_hashes(words)
    take = min(size, len(words))
    out = np.full(len(words) - take + 1, take, np.uint64)
    for j in range(take):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(out)]
    return np.unique(mixed(out).view(np.int64))


def class_of(grams: np.ndarray) -> int | None:
    """A 64-bit name of a set."""
    if not len(grams):
        return None
    total = mixed(grams.view(np.uint64) ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int(mixed(np.array([total ^ np.uint64(len(grams))]))[0].view(np.int64))


def prefix_length(n: int, percent: int) -> int:
    """Columns of which a linked partner must share one: n - ceil(t n) + 1."""
    return n + 1 - -(-percent * n // 100)


def _long_list(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _pack_lists(arrays: list[np.ndarray]) -> tuple[bytes, bytes]:
    """Lists of sorted columns as compressed differences, and their lengths."""
    flat = [np.diff(x, prepend=0) for x in arrays]
    return pack_numbers(np.concatenate([np.zeros(0, np.int64), *flat])), pack_numbers(np.array([len(x) for x in arrays], np.int64))


def _unpack_lists(values: bytes, lengths: bytes) -> list[np.ndarray]:
    ends = np.concatenate([[0], np.cumsum(unpack_numbers(lengths))])
    flat = unpack_numbers(values)
    return [np.cumsum(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


PROFILES = (
    "block long, docs array<struct<doc_id: long, digest: binary, cls: long, n: long>>, "
    "counted binary, counted_sizes binary, rest binary, rest_sizes binary, texts binary, columns long"
)


def _profiles(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Blocks of documents: class and set size of each, its counted columns, and others that its prefix needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rows: list[dict] = []
        counted: list[np.ndarray] = []
        rest: list[np.ndarray] = []
        texts: list[bytes] = []
        held: set[int | None] = set()
        chars = 0

        def done() -> pa.RecordBatch:
            kind = pa.list_(pa.struct({"doc_id": pa.int64(), "digest": pa.binary(), "cls": pa.int64(), "n": pa.int64()}))
            cells = [*_pack_lists(counted), *_pack_lists(rest), pack_words(texts)]
            total = sum(map(len, counted))
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([rows], kind), *[pa.array([x], pa.binary()) for x in cells], pa.array([total], pa.int64())],
                ["block", "docs", "counted", "counted_sizes", "rest", "rest_sizes", "texts", "columns"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                grams = gram_set(data, size)
                columns = grams.view(np.uint64)
                is_counted = columns % np.uint64(COUNTED) == 0
                # 40 bits of the hash name a column; the set is sorted by signed hash, columns by unsigned
                mine = np.sort((columns[is_counted] >> np.uint64(COLUMN_SHIFT)).astype(np.int64))
                more = max(0, prefix_length(len(grams), percent) - len(mine)) if len(grams) else 0
                others = np.sort((columns[~is_counted] >> np.uint64(COLUMN_SHIFT)).astype(np.int64))[:more]
                cls = class_of(grams)
                rows.append({"doc_id": doc_id, "digest": hashlib.md5(data).digest(), "cls": cls, "n": len(grams)})
                # a block needs a class's text once, at its first document with an id
                texts.append(data if doc_id is not None and cls not in held else b"")
                if doc_id is not None:
                    held.add(cls)
                counted.append(mine)
                rest.append(others)
                chars += len(text or "")
                if chars >= BLOCK_CHARS or len(rows) >= BLOCK_DOCS:
                    yield done()
                    number, rows, counted, rest, texts, chars = number + 1, [], [], [], [], 0
                    held.clear()
        if rows:
            yield done()
        pa.default_memory_pool().release_unused()  # the worker lives on

    return docs.mapInArrow(run, PROFILES)


def _block_columns(counted: list[np.ndarray], slots: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct counted columns of a block's classes, and of how many classes each is."""
    flat = np.concatenate([np.zeros(0, np.int64), *[np.unique(counted[i]) for i in slots]])
    return np.unique(flat, return_counts=True)


def _blocks(profiles: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Rows ``(h, cls, n)``: the columns that a class may share with a linked one.

    The classes' counted columns go out once, a compressed row a block and
    bucket of columns; what comes back is which of them other classes have,
    too, and in how many classes they are.
    """
    total = profiles.agg(F.sum("columns").alias("n")).first()["n"] or 0
    buckets = bucket_count(total)
    slots = first.groupBy("block").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    slots = written(slots, "jaccard-slots")
    chosen = profiles.join(slots, "block")

    def counted_of(batch: pa.RecordBatch, at: int) -> tuple[list[np.ndarray], list[int]]:
        cells = [batch.column(c)[at].as_py() for c in ("counted", "counted_sizes")]
        return _unpack_lists(*cells), batch.column("slots")[at].as_py()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                columns, counts = _block_columns(*counted_of(batch, at))
                yield sent_rows(batch.column("block")[at].as_py(), columns, counts, buckets)

    sent = chosen.select("block", "counted", "counted_sizes", "slots").mapInArrow(send, SENT)
    whole = with_found(chosen, repeated_values(sent))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                counted, mine = counted_of(batch, at)
                rest = _unpack_lists(*[batch.column(c)[at].as_py() for c in ("rest", "rest_sizes")])
                columns, _ = _block_columns(counted, mine)
                df = occurrences(columns, batch.column("found")[at].as_py(), buckets)
                docs = batch.column("docs")[at].values
                classes, sizes = (pc.fill_null(docs.field(c), 0).to_numpy() for c in ("cls", "n"))
                h, cls, n = [], [], []
                for slot in mine:
                    own = counted[slot]
                    degree = df[np.searchsorted(columns, own)]
                    # the order of columns: counted ones by count, then the others; those of one class link nothing
                    order = np.lexsort((own, degree))[: prefix_length(int(sizes[slot]), percent)]
                    kept = np.unique(np.concatenate([own[order][degree[order] > 1], rest[slot]]))
                    h.append(kept)
                    cls.append(np.full(len(kept), classes[slot], np.int64))
                    n.append(np.full(len(kept), sizes[slot], np.int64))
                lists = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (h, cls, n)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in lists], ["h", "cls", "n"])

    return whole.drop("block", "columns").mapInArrow(prefixes, "h long, cls long, n long")


def _texts(profiles: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows ``(cls, text)``: the compressed whole text of each chosen class (cls, block, slot)."""
    slots = chosen.groupBy("block").agg(F.collect_list(F.struct("slot", "cls")).alias("slots"))
    held = profiles.select("block", "texts").join(written(slots, "jaccard-chosen-slots"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                texts = unpack_words(batch.column("texts")[at].as_py())
                slots = batch.column("slots")[at].as_py()
                packed = [pa.compress(texts[x["slot"]], "zstd", asbytes=True) for x in slots]
                sizes = [len(texts[x["slot"]]) for x in slots]
                names = pa.array([x["cls"] for x in slots], pa.int64())
                yield pa.RecordBatch.from_arrays([names, pa.array(packed, pa.binary()), pa.array(sizes, pa.int64())], ["cls", "text", "bytes"])

    return held.mapInArrow(run, "cls long, text binary, bytes long")


def _grams(text: bytes, size_in_bytes: int, size: int) -> np.ndarray:
    return gram_set(pa.decompress(text, size_in_bytes, "zstd", asbytes=True), size)


#: N-grams of a tile, a row on average.
TILE_GRAMS = 2000
#: Pairs of one document that a task verifies; documents with more are split.
PAIRS = 2000


def _overlaps(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked: overlap of the whole rows against the union.

    Texts lie in buckets by class, so a pair comes to its first text; that goes
    on to the second one, whose pairs are parted if there are many.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).alias("parts"))
    parts = written(parts, "jaccard-parts")
    many = parts.filter("parts > 1")
    other = texts.select(F.col("cls").alias("b"), F.col("text").alias("y"), F.col("bytes").alias("y_bytes"))
    left = pairs.join(many, "a", "left").join(other, "b")
    left = left.withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))))
    own = texts.select(F.col("cls").alias("a"), F.col("text").alias("x"), F.col("bytes").alias("x_bytes")).join(parts, "a")
    own = own.select("a", "x", "x_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    both = left.join(own, ["a", "part"]).select("a", "b", "x", "x_bytes", "y", "y_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, grams = None, None
        for batch in batches:
            found = []
            for a, b, x, x_bytes, y, y_bytes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != last:
                    last, grams = a, _grams(x, x_bytes, size)
                others = _grams(y, y_bytes, size)
                overlap = len(np.intersect1d(grams, others, assume_unique=True))
                if 100 * overlap >= percent * (len(grams) + len(others) - overlap):
                    found.append((a, b))
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _tile_links(rows: pa.Table, size: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles' rows (or within one tile)."""
    side, cls, label = (rows.column(c).to_numpy() for c in ("side", "cls", "label"))
    lists = [_grams(x, k, size) for x, k in zip(rows.column("text").to_pylist(), rows.column("bytes").to_pylist(), strict=True)]
    n = np.array([len(x) for x in lists])
    ends = np.concatenate([[0], np.cumsum(n)])
    # column numbers over both tiles; every row's columns stand together
    _, column = np.unique(np.concatenate(lists), return_inverse=True)
    parent = {int(x): int(x) for x in label}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    two = bool(side.min() != side.max())
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if two else left
    right = right[np.argsort(n[right], kind="stable")]
    sizes = n[right]
    flat = np.concatenate([column[ends[j] : ends[j + 1]] for j in right]) if len(right) else column[:0]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(column.max(initial=-1)) + 1, np.int32)
    found = []
    for i in left:
        # sizes of partners: percent * larger <= 100 * smaller
        a = int(np.searchsorted(sizes, -(-percent * n[i] // 100)))
        b = int(np.searchsorted(sizes, 100 * n[i] // percent, side="right"))
        if a >= b:
            continue
        own = column[ends[i] : ends[i + 1]]
        mark[own] = 1
        overlap = np.add.reduceat(mark[flat[starts[a] : starts[b]]], starts[a:b] - starts[a])
        mark[own] = 0
        for j in right[a:b][100 * overlap >= percent * (n[i] + sizes[a:b] - overlap)]:
            x, y = root(int(label[i])), root(int(label[j]))
            if x != y:
                parent[y] = x
                found.append((int(cls[i]), int(cls[j])))
    return found


def _product(blocks: DataFrame, texts: DataFrame, size: int, percent: int, tile: int) -> DataFrame:
    """Links (a, b) between rows (h, cls, n, label) of wide blocks, by tiles of their product."""
    centre = blocks.groupBy("h").agg(F.min("cls").alias("a"))
    joined = connected_components(blocks.join(centre, "h").select("a", F.col("cls").alias("b")))
    rows = blocks.select("cls", "n", "label").distinct()
    rows = rows.join(joined.select(F.col("v").alias("cls"), F.col("label").alias("grp")), "cls")
    step = float(np.log(100 / percent))
    rows = rows.withColumn("s", F.floor(F.log("n") / step + 1e-9))  # linked rows are at most one class apart
    rows = written(rows, "jaccard-wide-rows")
    # a tile is bounded by rows and by what they hold
    tiles = rows.groupBy("grp", "s").agg(F.ceil(F.greatest(F.count("*") / tile, F.sum("n") / (tile * TILE_GRAMS))).alias("m"))
    tiles = written(tiles, "jaccard-tiles")
    near = tiles.select("grp", (F.col("s") - 1).alias("s"), F.col("m").alias("above"))
    far = tiles.select("grp", (F.col("s") + 1).alias("s"), F.col("m").alias("below"))
    around = tiles.join(near, ["grp", "s"], "left").join(far, ["grp", "s"], "left")
    dealt = rows.join(around, ["grp", "s"]).withColumn("sub", F.pmod(F.xxhash64("cls"), F.col("m")))
    upto = lambda m: F.when(m > 0, F.sequence(F.lit(0).cast("long"), m - 1)).otherwise(F.array().cast("array<long>"))  # noqa: E731,E501
    key = lambda low, a, b, side: F.struct(
        low.alias("low"), a.alias("a"), b.alias("b"), F.lit(side[0]).alias("up"), side[1].alias("side")
    )
    sub, zero = F.col("sub"), F.coalesce
    own = F.transform(upto(F.col("m")), lambda j: key(F.col("s"), F.least(sub, j), F.greatest(sub, j), (0, F.when(sub <= j, 0).otherwise(1))))
    up = F.transform(upto(zero("above", F.lit(0))), lambda j: key(F.col("s"), sub, j, (1, F.lit(0))))
    down = F.transform(upto(zero("below", F.lit(0))), lambda j: key(F.col("s") - 1, j, sub, (1, F.lit(1))))
    sent = dealt.select("grp", "cls", "label", F.explode(F.concat(own, up, down)).alias("k")).join(texts, "cls")
    keys = ["grp", "low", "a", "b", "up"]
    sent = sent.select("grp", "k.low", "k.a", "k.b", "k.up", "k.side", "cls", "label", "text", "bytes")

    def links(rows: pa.Table) -> pa.Table:
        found = _tile_links(rows, size, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return sent.groupBy(*keys).applyInArrow(links, "a long, b long")


def _labelled(docs: DataFrame, size: int, percent: int, tries: int, narrow: int, tile: int) -> DataFrame:
    """Rows ``(doc_id, digest, n, label)``, one a document: documents of a component have the same label.

    Documents without n-grams have none; one without an id is a component of its own.
    """
    ship_package(docs.sparkSession)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiles = written_buckets(_profiles(whole, size, percent), "jaccard-profiles", "block")
    each = profiles.select("block", F.posexplode("docs").alias("slot", "d")).select("block", "slot", "d.*")
    known = each.filter("cls IS NOT NULL AND doc_id IS NOT NULL")
    # a row for each class: its first document's
    first = known.groupBy("cls").agg(F.min(F.struct("block", "slot")).alias("f"))
    first = written(first.select("cls", "f.block", "f.slot"), "jaccard-first")
    blocks = written(_blocks(profiles, first, percent), "jaccard-blocks")
    wide = blocks.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1")
    blocks = written(blocks.join(wide, "h"), "jaccard-shared")
    chosen = written(first.select("cls", "block", "slot").join(blocks.select("cls").distinct(), "cls"), "jaccard-chosen")
    texts = written_buckets(_texts(profiles, chosen), "jaccard-texts", "cls")
    labels = chosen.select(F.col("cls").alias("v"), F.col("cls").alias("label"))
    links: DataFrame | None = None

    def add(found: DataFrame) -> None:
        nonlocal links, labels
        found = written(found, "jaccard-links")
        if found.limit(1).count():
            links = found if links is None else links.unionByName(found)
            joined = connected_components(links)
            alone = chosen.select(F.col("cls").alias("v")).join(joined.select("v"), "v", "left_anti")
            labels = written(joined.unionByName(alone.select("v", F.col("v").alias("label"))), "jaccard-labels")

    def undecided() -> DataFrame:
        """Rows of the blocks that hold more than one group."""
        now = blocks.join(labels.select(F.col("v").alias("cls"), "label"), "cls")
        mixed_blocks = now.groupBy("h").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1")
        return now.join(mixed_blocks.select("h"), "h")

    def verified(pairs: DataFrame) -> DataFrame:
        sizes_allow = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
        pairs = written(pairs.filter(sizes_allow).select(*ends).distinct(), "jaccard-pairs")
        return _overlaps(pairs, texts, size, percent)

    for k in range(tries):
        now = undecided()
        order = F.xxhash64(F.lit(k), "cls")
        row = F.struct(order.alias("o"), F.col("cls").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
        centre = now.groupBy("h").agg(F.min(row).alias("c")).select("h", "c.a", "c.na", "c.la")
        pairs = now.join(centre, "h").filter("label <> la")
        add(verified(pairs.select("a", "na", F.col("cls").alias("b"), F.col("n").alias("nb"))))
    now = written(undecided(), "jaccard-undecided")
    few = now.filter(F.col("k") <= narrow)
    other = few.select("h", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    pairs = few.join(other, "h").filter("label <> la AND a < cls")
    add(verified(pairs.select("a", "na", F.col("cls").alias("b"), F.col("n").alias("nb"))))
    many = now.filter(F.col("k") > narrow)
    if many.limit(1).count():
        many = many.drop("label").join(labels.select(F.col("v").alias("cls"), "label"), "cls")
        add(_product(many.select("h", "cls", "n", "label"), texts, size, percent, tile))
    rows = each.select("doc_id", "digest", "n", "cls").join(labels.select(F.col("v").alias("cls"), "label"), "cls", "left")
    return rows.withColumn("label", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "cls"))).drop("cls")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4,
    percent: int = 85,
    tries: int = 1,
    narrow: int = 32,
    tile: int = 1024,
) -> DataFrame:
    """Rows ``(doc_id, n_shingles, component_id)``, one a document.

    Documents link when ``100 * intersection >= percent * union`` of their sets
    of ``size``-word shingles; a component is named by its smallest id.
    ``tries``, ``narrow`` and ``tile`` say how the work is cut, not its result.
    """
    rows = _labelled(_named(docs, id_col, text_col), size, percent, tries, narrow, tile)
    ids = rows.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return rows.join(ids, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near duplicates: of each component the document with the smallest id stays.

    Rows are told apart by id and text, so different texts under one id are
    documents of their own, and of rows that repeat an id and a text one
    stays.  Of documents without an id, exact copies go (the component's
    document with an id stays, if it has one); documents without words all stay.
    The texts are shuffled once, at the end, by id and digest.
    """
    rows = written(_labelled(_named(docs, id_col, text_col), size, percent, 1, 32, 1024), "jaccard-rows")
    with_id = rows.filter("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("doc_id", "digest")).alias("k"))
    anonymous = rows.filter("doc_id IS NULL AND n > 0").select("digest").distinct()
    same_text = rows.filter("doc_id IS NOT NULL AND n > 0").select("digest").distinct()
    anonymous = anonymous.join(same_text, "digest", "left_anti")
    stay = with_id.select("k.doc_id", "k.digest").unionByName(anonymous.select(F.lit(None).cast("long").alias("doc_id"), "digest"))
    stay = written(stay, "jaccard-stay")
    # plain columns as keys, so that the rows that the join brings together stay so for the distinct ones
    key, none, digest = (own_name(docs, x) for x in ("_id", "_none", "_digest"))
    zero = F.lit(0).cast("long")
    ident, text = F.col(quoted(id_col)).cast("long"), F.coalesce(F.col(quoted(text_col)), F.lit(""))
    named = docs.withColumns({key: F.coalesce(ident, zero), none: ident.isNull(), digest: F.unhex(F.md5(text))})
    has_words = text.rlike(r"[^\x20\x09-\x0D]")
    stay = stay.select(F.coalesce("doc_id", zero).alias(key), F.col("doc_id").isNull().alias(none), F.col("digest").alias(digest))
    kept = named.filter(has_words).join(stay, [key, none, digest], "left_semi").dropDuplicates([key, none, digest])
    columns = [F.col(quoted(c)) for c in docs.columns]
    return kept.select(*columns).unionAll(docs.filter(~has_words).select(*columns))
