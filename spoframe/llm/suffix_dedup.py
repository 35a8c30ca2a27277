"""Exact repeated byte strings by threshold-bounded interval expansion on a BWT.

Every byte covered by a ``least``-byte string that also starts earlier (in a
smaller document, or before it in the same one) is removed.

Documents are written once, in compressed blocks that do not move again: what
follows goes to a block, or comes from it, by block and slot.

1. Later copies of a whole text are covered wholly; one copy goes on.
2. Anchors are minimizers: of each ``least``-byte string, the ``GRAM``-byte
   string in it with the smallest hash.  Equal strings have equal anchors at
   equal places.  Strings whose anchor has a place in a certain range share the
   bytes around it that all of them hold, so an anchor goes on only if it occurs
   again together with those bytes, for one of ``RANGES`` ranges.
3. The context of an anchor holds all ``least``-byte strings that contain it at
   a place from the first of those ranges to the last: no others occur again.
   Of equal contexts every one but the first is covered wholly.
4. The different contexts of an anchor go to one block.  A block's suffixes
   are sorted by their first bytes, and breadth-first backward extension on
   the Burrows-Wheeler transform finds where neighbouring suffixes have common
   prefixes of so many bytes, of one byte more, and so on, from the largest
   number that sorting them by doubled prefixes has told; it stops at
   ``least``.  Suffixes without a
   boundary between them then start with the same ``least`` bytes; all but the
   earliest are covered.
5. An anchor with more than ``HOT_CONTEXTS`` different contexts is no block.
   Its ``least``-byte strings are parted by where the anchor stands in them:
   those with places a..b share the bytes around the anchor that all of them
   hold, so they meet under those bytes as a longer key.  The range of places is
   halved (and contexts cut to it, equal ones resolved as in 3) until a key has
   few contexts; a range of one place has whole strings as keys, so one context.

Only hashes are counted and joined; texts meet only in blocks of contexts.

Defined results: a NULL text counts as empty; NULL ids come after all others;
rows with equal id and text are one document (each gets its result), with
equal id and different text they are ordered by a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoframe.llm.common import quoted, ship_package, written, written_buckets
from spoframe.llm.hashing import mixed
from spoframe.llm.packed import pack_numbers, pack_words, unpack_numbers, unpack_words
from spoframe.llm.repeated import SENT, VALUE_BITS, bucket_count, occurrences, repeated_values, sent_rows, with_found

GRAM = 32
#: Bytes of contexts that a task holds in a block before it works them off.
BLOCK_BYTES = 1 << 18
#: Different contexts of one anchor that may go to one block.
HOT_CONTEXTS = 2048
#: Windows of a text whose places are numbered at once; one bit more holds a place.
PLACE_BITS = 22
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


#: Powers kept by a worker, up to this many of each base.
KEPT_POWERS = 1 << 21
_KEPT: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """``base ** 0`` to ``base ** n``, modulo 2**64."""
    kept = _KEPT.get(base)
    if kept is not None and n < len(kept):
        return kept[: n + 1]
    out = np.full(max(n + 1, min(2 * n, KEPT_POWERS)), base, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if len(out) <= KEPT_POWERS:
        _KEPT[base] = out
    return out[: n + 1]


def _sums(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`_hash` gets the hash of any part."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=out[1:])
    return out


def _hash(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of data[start:end], the same wherever it stands.

    Sums grow with the place's power; its inverse takes that back.
    """
    return mixed((sums[end] - sums[start]) * inverse[start] ^ (end - start).astype(np.uint64))


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    done, out = 1, x
    while done * 2 <= width:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class _Hashed:
    """A text's bytes, with hashes of any of their parts."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        n = len(self.data)
        self.sums, self.inverse = _sums(self.data, _powers(n, _BASE)), _powers(n, _INVERSE)

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _hash(self.sums, self.inverse, start, end)


def anchors(data: bytes, least: int) -> np.ndarray:
    """Positions of the minimizers of a text's bytes."""
    n, span = len(data), least - GRAM + 1
    if n < least:
        return np.zeros(0, np.int64)
    at = np.arange(n - GRAM + 1)
    grams = _Hashed(data).part(at, at + GRAM)
    # hash and place in one number: the smallest of a window is its first smallest hash
    found = []
    for a in range(0, n - least + 1, 1 << PLACE_BITS):
        part = grams[a : a + (1 << PLACE_BITS) + span - 1]
        key = (part & ~np.uint64((2 << PLACE_BITS) - 1)) | np.arange(len(part), dtype=np.uint64)
        place = (_smallest(key, span) & np.uint64((2 << PLACE_BITS) - 1)).astype(np.int64) + a
        found.append(place[np.append(True, place[1:] != place[:-1])])
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


#: Ranges of places that an anchor may have in a ``least``-byte string.
RANGES = 4


def _cuts(least: int) -> np.ndarray:
    """Where each range of places begins (and the last one ends)."""
    return np.array([k * (least - GRAM + 1) // RANGES for k in range(RANGES + 1)])


def _windows(text: _Hashed, p: np.ndarray, least: int) -> np.ndarray:
    """By range and anchor, a name of the bytes that all strings with the anchor in that range share (-1: they leave the text)."""
    cuts, n = _cuts(least)[:, None], len(text.data)
    # strings that begin cuts[k]..cuts[k + 1] - 1 bytes before the anchor
    start, end = p - cuts[:-1], p + (least + 1 - cuts[1:])
    named = mixed(text.part(np.maximum(start, 0), np.minimum(end, n)) + np.arange(1, RANGES + 1, dtype=np.uint64)[:, None])
    return np.where((start >= 0) & (end <= n), (named >> np.uint64(64 - VALUE_BITS)).astype(np.int64), -1)


def boundaries(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` (0: separator) in order, and where their first ``least`` bytes change.

    The second has one more entry than the first: whether a new string begins
    at a place of the order, and at its end.
    """
    n = len(text)
    # characters that occur, in order, by as few bits as they need; as many as fit in one number
    code = np.cumsum(np.bincount(text, minlength=1) > 0) - 1 + (text.min(initial=1) > 0)
    bits = max(1, int(code[-1]).bit_length())
    depth = 64 // bits
    padded = np.concatenate([code[text], np.zeros(64, np.int64)]).astype(np.uint64)
    rank = np.zeros(n, np.uint64)
    for j in range(depth):
        rank = (rank << np.uint64(bits)) | padded[j : j + n]
    order = np.argsort(rank)
    first = text[order]
    seed, seeded = np.append(True, first[1:] != first[:-1]), 1
    while depth < least:
        ordered = rank[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        seed, seeded = new, depth  # these places stay when the order is refined
        number = np.zeros(n + depth, np.int64)
        number[order] = np.cumsum(new)
        if new.all():
            return order, np.ones(n + 1, bool)
        rank = number[:n] * (n + 2) + number[depth : depth + n]
        order = np.argsort(rank)
        depth *= 2
    # the transform: the character before each suffix, and where that longer suffix stands
    before = text[order - 1]
    before[order == 0] = 0
    back = np.argsort(before, kind="stable")
    # back lists rows by the character before them, so row back[k] leads to place k
    leads = np.empty(n, np.int32)
    leads[back] = np.arange(n, dtype=np.int32)
    following = np.full(n, n, np.int32)  # the next row with the same character before it
    character = before[back]
    same = character[1:] == character[:-1]
    following[back[:-1][same]] = back[1:][same]
    edge = np.append(seed, True)
    waiting = np.flatnonzero(before != 0)
    behind = following[waiting]
    for _ in range(seeded, least):
        # a row is the last of its character in its interval if a boundary stands before the next one:
        # the interval extended by that character ends behind the place it leads to
        so_far = np.cumsum(edge, dtype=np.int32)
        last = so_far[behind] > so_far[waiting]
        if not last.any():
            break
        edge[leads[waiting[last]] + 1] = True
        waiting, behind = waiting[~last], behind[~last]
    return order, edge


def _block_spans(contexts: list[tuple[int, int, int, bytes]], least: int) -> list[tuple[int, int, int, int]]:
    """Covered spans (doc, tie, start, end) of contexts (doc, tie, start, bytes)."""
    lengths = np.array([len(c[3]) + 1 for c in contexts])
    text = np.frombuffer(b"".join(x for c in contexts for x in (c[3], b"\0")), np.uint8).astype(np.uint16) + np.uint16(1)
    starts = np.cumsum(lengths) - lengths
    text[starts + lengths - 1] = 0
    of = np.repeat(np.arange(len(contexts)), lengths)
    inside = np.arange(len(text)) - starts[of]
    order, edge = boundaries(text, least)
    group = np.cumsum(edge[:-1])
    whole = (inside + least <= lengths[of] - 1)[order]
    row, group = order[whole], group[whole]
    doc, tie, start = (np.array([c[k] for c in contexts], np.int64) for k in range(3))
    # a number for each document, in their order, and the string's place in it
    by = np.lexsort((tie, doc))
    new = np.append(False, (doc[by][1:] != doc[by][:-1]) | (tie[by][1:] != tie[by][:-1]))
    document = np.empty(len(contexts), np.int64)
    document[by] = np.cumsum(new)
    at = (document * (int((start + lengths).max()) + 1) + start)[of[row]] + inside[row]
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    later = at != np.repeat(np.minimum.reduceat(at, heads) if len(heads) else at, np.diff(np.append(heads, len(at))))
    found = np.zeros(len(text), bool)
    found[row[later]] = True
    out = []
    for i in np.unique(of[row[later]]):
        at = np.flatnonzero(found[starts[i] : starts[i] + lengths[i]])
        cut = np.flatnonzero(np.diff(at) > least)
        for a, b in zip(np.append(at[0], at[cut + 1]), np.append(at[cut], at[-1]), strict=True):
            out.append((int(doc[i]), int(tie[i]), int(start[i] + a), int(start[i] + b + least)))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


#: Bytes of the texts of a block (a longer text is a block of its own).
TEXT_BYTES = 6_000_000
BLOCKS = (
    "block long, docs array<struct<doc_id: long, doc: long, tie: long, digest: binary, n: long>>, "
    "texts binary, places binary, sizes binary, anchors long"
)


def _text_blocks(rows: DataFrame, least: int) -> DataFrame:
    """Blocks of documents (doc_id, doc, tie, digest, n, data) with their texts and the places of their anchors.

    Of equal texts in a block the first has anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        docs: list[dict] = []
        texts: list[bytes] = []
        places: list[np.ndarray] = []
        seen: set[bytes] = set()
        size = 0

        def done() -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("digest", pa.binary()), ("n", pa.int64())]))
            flat = np.concatenate([np.zeros(0, np.int64), *[np.diff(p, prepend=0) for p in places]])
            cells = [pack_words(texts), pack_numbers(flat), pack_numbers(np.array([len(p) for p in places], np.int64))]
            columns = [pa.array([number], pa.int64()), pa.array([docs], kind), *[pa.array([x], pa.binary()) for x in cells]]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array([len(flat)], pa.int64())], ["block", "docs", "texts", "places", "sizes", "anchors"]
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for row in batch.slice(at, 200).to_pylist():
                    data = row.pop("data")
                    if docs and size + len(data) > TEXT_BYTES:
                        yield done()
                        number, docs, texts, places, size = number + 1, [], [], [], 0
                        seen.clear()
                    docs.append(row)
                    texts.append(data)
                    places.append(np.zeros(0, np.int64) if row["digest"] in seen else anchors(data, least))
                    seen.add(row["digest"])
                    size += len(data)
        if docs:
            yield done()

    return rows.select("doc_id", "doc", "tie", "digest", "n", "data").mapInArrow(run, BLOCKS)


def _chosen_texts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[dict, bytes, np.ndarray]]:
    """Of a block's row the texts that go on: what is known of each, its bytes, and the places of its anchors."""
    texts = unpack_words(batch.column("texts")[at].as_py())
    ends = np.concatenate([[0], np.cumsum(unpack_numbers(batch.column("sizes")[at].as_py()))])
    flat = unpack_numbers(batch.column("places")[at].as_py())
    docs = batch.column("docs")[at].values
    for slot in batch.column("slots")[at].as_py():
        p = np.cumsum(flat[ends[slot] : ends[slot + 1]])
        if len(p):
            yield docs[slot].as_py() | {"slot": slot}, texts[slot], p


#: ``a``, ``b``: the places that the anchor has in strings that may occur again, the first and the last.
PLACES = "h long, c long, doc long, tie long, n long, block long, slot int, p long, a int, b int"


def _repeated_anchors(blocks: DataFrame, go: DataFrame, least: int) -> DataFrame:
    """Rows of :data:`PLACES`: anchors that occur again with most bytes of a string, and their contexts' hashes."""
    total = blocks.agg(F.sum("anchors").alias("n")).first()["n"] or 0
    buckets = bucket_count(RANGES * total)
    slots = go.groupBy("block").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    chosen = blocks.join(written(slots, "suffix-slots"), "block")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                values = [_windows(_Hashed(data), p, least).ravel() for _, data, p in _chosen_texts(batch, at)]
                flat = np.concatenate([np.zeros(0, np.int64), *values])
                found, counts = np.unique(flat[flat >= 0], return_counts=True)
                yield sent_rows(batch.column("block")[at].as_py(), found, counts, buckets)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PLACES.split(", ")]
        cuts = _cuts(least)
        for batch in batches:
            for at in range(batch.num_rows):
                block = batch.column("block")[at].as_py()
                # hashes of whole texts are made anew where something repeats, not held for the block
                held = [(doc, data, p, _windows(_Hashed(data), p, least)) for doc, data, p in _chosen_texts(batch, at)]
                flat = np.concatenate([np.zeros(0, np.int64), *[x[3].ravel() for x in held]])
                known = flat >= 0
                values, number = np.unique(flat[known], return_inverse=True)
                again = np.zeros(len(flat), bool)
                again[known] = (occurrences(values, batch.column("found")[at].as_py(), buckets) > 1)[number]
                columns: list[list[np.ndarray]] = [[] for _ in names]
                done = 0
                for doc, data, p, windows in held:
                    repeats = again[done : done + windows.size].reshape(windows.shape)
                    done += windows.size
                    goes = repeats.any(0)
                    if not goes.any():
                        continue
                    p, repeats = p[goes], repeats[:, goes]
                    # strings with the anchor in the other ranges of places do not occur again
                    a, b = cuts[repeats.argmax(0)], cuts[RANGES - repeats[::-1].argmax(0)] - 1
                    start = np.maximum(p - b, 0)
                    text = _Hashed(data)
                    h = text.part(p, p + GRAM).view(np.int64)
                    whole = text.part(start, np.minimum(p + least - a, doc["n"]))
                    c = mixed(whole + (p - start).astype(np.uint64)).view(np.int64)  # the anchor stands at the same place, too
                    same = [np.full(len(p), doc[k], np.int64) for k in ("doc", "tie", "n")]
                    cells = [h, c, *same, np.full(len(p), block, np.int64), np.full(len(p), doc["slot"], np.int32), p, a, b]
                    for column, cell in zip(columns, cells, strict=True):
                        column.append(cell)
                kinds = [np.int32 if n in ("slot", "a", "b") else np.int64 for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, k), *x]).astype(k)) for x, k in zip(columns, kinds, strict=True)], names)

    sent = chosen.drop("anchors").mapInArrow(send, SENT)
    whole = with_found(chosen.drop("anchors"), repeated_values(sent))
    return whole.mapInArrow(emit, PLACES)


def _context_blocks(rows: DataFrame, least: int) -> DataFrame:
    """Covered spans found in the contexts (h, doc, tie, start, data) of each partition, sorted by h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def done() -> pa.RecordBatch:
            spans = _block_spans(held, least)
            columns = list(zip(*spans, strict=True)) if spans else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "tie", "a", "b"])

        for batch in batches:
            for h, doc, tie, start, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if h != last and size >= BLOCK_BYTES:
                    yield done()
                    held, size = [], 0
                held.append((doc, tie, start, data))
                size += len(data)
                last = h
        if held:
            yield done()

    return rows.select("h", "doc", "tie", "start", "data").mapInArrow(run, "doc long, tie long, a long, b long")


def _part(data: Column, start: Column, end: Column) -> Column:
    return F.substring(data, (start + 1).cast("int"), (end - start).cast("int"))


def _cut(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (h, doc, tie, n, block, slot, p, start, end) with the bytes of its context as ``data``."""
    kinds = "h long, doc long, tie long, n long, p long, start long, data binary"
    fields = ["h", "doc", "tie", "n", "slot", "p", "start", "end"]
    lists = wanted.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                texts = unpack_words(batch.column("texts")[at].as_py())
                w = batch.column("w")[at].values
                slots, starts, ends = (w.field(c).to_pylist() for c in ("slot", "start", "end"))
                data = [texts[i][a:b] for i, a, b in zip(slots, starts, ends, strict=True)]
                same = [w.field(c) for c in ("h", "doc", "tie", "n", "p", "start")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(data, pa.binary())], [k.split()[0] for k in kinds.split(", ")])

    return blocks.select("block", "texts").join(lists, "block").select("texts", "w").mapInArrow(run, kinds)


def _split_hot(hot: DataFrame, least: int, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Blocks (h, doc, tie, start, data) of at most ``most`` contexts, and covered spans, of hot anchors' contexts.

    ``hot``: as from :func:`_cut`.  Each round halves the places that the anchor may have in a string.
    """
    blocks, covered = [], []
    side = least - GRAM
    state = hot.withColumns({"a": F.lit(0), "b": F.lit(side)})
    for _ in range(side.bit_length()):
        mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.array(F.struct(F.col("a").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("b").alias("b")))
        parted = state.withColumn("half", F.explode(F.when(F.col("a") < F.col("b"), halves))).withColumns(
            {"a": F.col("half.a"), "b": F.col("half.b")}
        )
        # only places at which a string lies within the context
        end = F.col("start") + F.octet_length("data")
        fits = F.greatest("a", F.col("p") + least - end) <= F.least(F.col("b"), F.col("p") - F.col("start"))
        lo, hi = F.greatest(F.col("p") - F.col("b"), F.col("start")), F.least(F.col("p") + least - F.col("a"), end)
        parted = parted.filter(fits).withColumns({"lo": lo, "hi": hi})
        held = _part(F.col("data"), F.col("p") - F.col("a") - F.col("start"), F.col("p") + least - F.col("b") - F.col("start"))
        part = _part(F.col("data"), F.col("lo") - F.col("start"), F.col("hi") - F.col("start"))
        key = F.xxhash64("h", "a", "b", held).alias("h")
        shown = parted.select(key, "a", "b", "doc", "tie", "n", "p", F.col("lo").alias("start"), F.col("hi").alias("end"), part.alias("data"))
        content = F.concat(F.unhex(F.md5("data")), F.unhex(F.hex(F.col("p") - F.col("start"))))
        shown = written(shown.withColumn("c", content), "suffix-hot")
        first = shown.groupBy("h", "c").agg(F.min(F.struct("doc", "tie", "p")).alias("f"), F.count("*").alias("k"))
        first = written(first, "suffix-hot-contexts")
        again = shown.join(first.filter("k > 1").select("h", "c", "f"), ["h", "c"])
        again = again.filter("struct(doc, tie, p) <> struct(f.doc, f.tie, f.p)")
        covered.append(again.select("doc", "tie", F.col("start").alias("a"), F.col("end").alias("b")))
        sizes = written(first.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"), "suffix-hot-keys")
        ours = first.select("h", F.col("f.doc").alias("doc"), F.col("f.tie").alias("tie"), F.col("f.p").alias("p"))
        left = shown.join(ours.join(sizes, "h"), ["h", "doc", "tie", "p"])
        blocks.append(left.filter(F.col("m") <= most).select("h", "doc", "tie", "start", "data"))
        state = left.filter(F.col("m") > most).drop("c", "m", "end")
        if sizes.filter(F.col("m") > most).isEmpty():
            break
    return blocks, covered


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 100, hot_contexts: int = HOT_CONTEXTS
) -> DataFrame:
    """Rows ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans)``, one a document.

    ``kept``: the bytes that stay (binary); ``spans``: the removed ones as (start, end).
    """
    if least <= GRAM:
        raise ValueError(f"least must be over {GRAM}")
    ident = F.col(quoted(id_col)).cast("long")
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    top = F.lit((1 << 63) - 1)
    rows = docs.select(
        ident.alias("doc_id"), F.coalesce(ident, top).alias("doc"), F.xxhash64(text).alias("tie"),
        text.cast("binary").alias("data"), F.octet_length(text).cast("long").alias("n"), F.unhex(F.md5(text)).alias("digest"),
    )
    ship_package(docs.sparkSession)
    texts = written_buckets(_text_blocks(rows, least), "suffix-texts", "block")
    each = texts.select("block", F.posexplode("docs").alias("slot", "d")).select("block", "slot", "d.*")
    # of equal texts the first goes on; equal rows of one document have the same places
    first = each.groupBy("digest").agg(F.min(F.struct("doc", "block", "slot")).alias("f")).select("digest", "f.*")
    first = written(first, "suffix-first")
    seen = written(_repeated_anchors(texts, first.select("block", "slot"), least), "suffix-repeated")
    start, end = F.greatest(F.col("p") - F.col("b"), F.lit(0)), F.least(F.col("p") + least - F.col("a"), F.col("n"))
    seen = seen.withColumns({"start": start, "end": end}).drop("a", "b")
    place = F.struct("doc", "tie", "p", "n", "block", "slot", "start", "end")
    contexts = seen.groupBy("h", "c").agg(F.min(place).alias("f"), F.count("*").alias("k"))
    contexts = written(contexts, "suffix-contexts")
    more = contexts.filter("k > 1").select("h", "c", "f")
    covered = seen.join(more, ["h", "c"]).filter("end - start >= %d AND struct(doc, tie, p) <> struct(f.doc, f.tie, f.p)" % least)
    covered = covered.select("doc", "tie", F.col("start").alias("a"), F.col("end").alias("b"))
    varied = written(contexts.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"), "suffix-varied")
    few, many = F.col("m") <= hot_contexts, F.col("m") > hot_contexts
    wanted = contexts.select("h", "f.*")
    blocks = _cut(texts, wanted.join(varied.filter(few).select("h"), "h")).select("h", "doc", "tie", "start", "data")
    if not varied.filter(many).isEmpty():
        hot = _cut(texts, wanted.join(varied.filter(many).select("h"), "h"))
        split, resolved = _split_hot(hot, least, hot_contexts)
        for more_blocks in split:
            blocks = blocks.unionByName(more_blocks)
        for more_spans in resolved:
            covered = covered.unionByName(more_spans)
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(width, "h").sortWithinPartitions("h", "doc", "tie", "start")
    spans = covered.unionByName(_context_blocks(dealt, least))
    spans = written(spans.groupBy("doc", "tie").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "suffix-spans")
    # back to the blocks: spans of each document, and whole later copies
    copied = each.join(first.select("digest", F.col("doc").alias("first")), "digest").filter((F.col("doc") > F.col("first")) & (F.col("n") >= least))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))).alias("spans")
    gone = each.join(spans, ["doc", "tie"]).select("block", "slot", "spans").unionByName(copied.select("block", "slot", whole))
    gone = gone.groupBy("block").agg(F.collect_list(F.struct("slot", "spans")).alias("gone"))
    joined = texts.select("block", "docs", "texts").join(gone, "block", "left").select("docs", "texts", "gone")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
        for batch in batches:
            for at in range(batch.num_rows):
                ids = batch.column("docs")[at].values.field("doc_id").to_pylist()
                removed: dict[int, list[tuple[int, int]]] = {}
                for x in batch.column("gone")[at].as_py() or []:
                    removed.setdefault(x["slot"], []).extend((y["a"], y["b"]) for y in x["spans"])
                out = []
                for slot, (doc_id, data) in enumerate(zip(ids, unpack_words(batch.column("texts")[at].as_py()), strict=True)):
                    spans, kept, last = merged(removed.get(slot, [])), [], 0
                    for a, b in spans:
                        kept.append(data[last:a])
                        last = b
                    rest = b"".join([*kept, data[last:]])
                    out.append((doc_id, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest, [{"a": a, "b": b} for a, b in spans]))
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<a: long, b: long>>"
    return joined.mapInArrow(apply, kinds)
