"""Byte-level BPE over a corpus: each distinct word is encoded once.

Encoding.  Texts are cut into pre-tokens (the matches of the tokenizer's
pattern).  The exploded (position, word) rows of a block of texts are
aggregated before any shuffle: a block keeps its distinct words, numbered by
falling frequency, and its positions as a sequence of those numbers.  The
blocks are written, dealt to buckets, and do not move again; then

* the distinct words of all blocks meet by word (a hash bucket of them in a
  row a block), and each is encoded once;
* their ids go back to the block that holds the word;
* ids and positions of a block are joined, and every text's ids put together
  by position.

A word has one place a block whatever its frequency, so the most frequent word
of a corpus is no hot key.

Decoding.  The token-byte table is joined to the ids on the map side: it is
broadcast (its size is that of the tokenizer's vocabulary, not of the data), and
a text's tokens are taken from it in the order of their positions.

A task holds a shuffle partition of blocks (``BLOCK_CHARS`` characters each, or
one longer text) and remembers the words of one bucket.

Defined results: a NULL text counts as empty and has no ids.  Rows that
repeat an id or a text, or have a NULL id, keep their own result.  Special
tokens are not known: their strings are ordinary text.  Columns of the input
named like a result (``ids``; ``decoded``) are replaced.  An id that the
token-byte table lacks is an error.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoframe.llm.common import drop_columns, own_name, quoted, ship_package, written_buckets
from spoframe.llm.packed import pack_numbers, pack_words, unpack_numbers, unpack_words

#: Characters of the texts of one block (a longer text is a block of its own).
BLOCK_CHARS = 32_000_000
#: Characters that are cut into words at a time.
CUT_CHARS = 500_000
#: Distinct words whose buckets are found at a time.
CUT_WORDS = 50_000
#: Words whose ids are put together at a time.
PUT_WORDS = 200_000
#: Hash buckets of words: a task remembers the distinct words of one, up to ``REMEMBERED``.
BUCKETS = 1024
#: Beyond so many words of a bucket the memory starts anew (results do not change).
REMEMBERED = 2_000_000

PARTS = "array<struct<bucket: int, words: binary, numbers: binary>>"


def vocabulary_file(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """A public tokenizer's rank file and pattern (not part of this repository)."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _rank_lines(path: str) -> list[tuple[str, ...]]:
    with open(path, encoding="ascii") as f:
        return [tuple(line.split()) for line in f if line.strip()]


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """The token-byte table ``(id, bytes)`` of a rank file: a line holds a token in base 64 and its rank."""
    lines = spark.createDataFrame(_rank_lines(path), "token string, rank string")
    return lines.select(F.col("rank").cast("int").alias("id"), F.unbase64("token").alias("bytes"))


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tokenizer of a rank file, one a worker."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in _rank_lines(path)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class _Block:
    """Words and positions of the texts gathered so far."""

    def __init__(self, pattern):
        self._pattern = pattern
        self._coded: list[pa.DictionaryArray] = []
        self.lengths: list[int] = []
        self.rows: list[pa.RecordBatch] = []
        self.chars = 0

    def add(self, rows: pa.RecordBatch, texts: list[str]) -> None:
        """Cut some rows' texts into words; the rows are copied, so that the batch with its texts can go."""
        found = [self._pattern.findall(text) for text in texts]
        self.lengths += map(len, found)
        self.chars += sum(map(len, texts))
        self.rows.append(rows.take(pa.array(np.arange(len(texts)))))
        self._coded.append(pa.array(itertools.chain.from_iterable(found), pa.large_string()).dictionary_encode())

    def _numbered(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words, and their numbers by place; the words gathered are given up."""
        whole = pa.chunked_array(self._coded).unify_dictionaries()
        self._coded = []
        places = np.concatenate([c.indices.to_numpy() for c in whole.chunks])
        return whole.chunk(0).dictionary.cast(pa.large_binary()), places

    def finish(self, number: int) -> pa.RecordBatch:
        words, flat = self._numbered()
        order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        places = pack_numbers(rank[flat])
        del flat, order
        sums = (zlib.crc32(w) for at in range(0, len(words), CUT_WORDS) for w in words.slice(at, CUT_WORDS).to_pylist())
        bucket = np.fromiter(sums, np.int64, len(words)) % BUCKETS
        # by bucket, and sorted in each: neighbours resemble each other
        by = [("bucket", "ascending"), ("word", "ascending")]
        by_bucket = pc.sort_indices(pa.table({"bucket": bucket, "word": words}), sort_keys=by).to_numpy()
        words, rank, bucket = words.take(pa.array(by_bucket)), rank[by_bucket], bucket[by_bucket]
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(words)] if len(words) else [0]
        parts = [
            {"bucket": int(bucket[a]), "words": pack_words(words.slice(a, b - a).to_pylist()), "numbers": pack_numbers(rank[a:b])}
            for a, b in itertools.pairwise(cuts)
        ]
        rows = pa.Table.from_batches(self.rows).combine_chunks()
        structs = pa.StructArray.from_arrays([c.combine_chunks() for c in rows.columns], names=rows.column_names)
        kind = pa.list_(pa.struct({"bucket": pa.int32(), "words": pa.binary(), "numbers": pa.binary()}))
        columns = {
            "block": pa.array([number], pa.int64()),
            "lengths": pa.array([pack_numbers(np.array(self.lengths, np.int64))], pa.binary()),
            "places": pa.array([places], pa.binary()),
            "parts": pa.array([parts], kind),
            "carried": pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs),
        }
        return pa.RecordBatch.from_pydict(columns)


def _blocks_task(pattern_text: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pattern = regex.compile(pattern_text)
        number = TaskContext.get().partitionId() << 32
        block = _Block(pattern)
        for batch in batches:
            rows, text_at = batch.select(batch.schema.names[:-1]), batch.column("text")
            at = 0
            while at < batch.num_rows:
                texts, chars = [], 0  # one text at least
                while at + len(texts) < batch.num_rows and chars < CUT_CHARS:
                    texts.append(text_at[at + len(texts)].as_py())
                    chars += len(texts[-1])
                if block.rows and block.chars + chars > BLOCK_CHARS:
                    full, block = block, None
                    yield full.finish(number)
                    number, block, full = number + 1, _Block(pattern), None
                block.add(rows.slice(at, len(texts)), texts)
                at += len(texts)
        if block.rows:
            yield block.finish(number)
        del block
        pa.default_memory_pool().release_unused()  # the worker lives on

    return task


def _encode_task(path: str, pattern: str):
    """The ids of the words of each row; rows come bucket by bucket, and a bucket's words are encoded once."""

    def task(batches):
        coder = encoding(path, pattern)
        bucket, known = None, {}
        for batch in batches:
            sizes, ids = [], []
            for b, packed in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if b != bucket or len(known) > REMEMBERED:
                    bucket, known = b, {}
                words = unpack_words(packed)
                for w in words:
                    if w not in known:
                        known[w] = coder.encode_ordinary(w.decode())
                found = [known[w] for w in words]
                sizes.append(pack_numbers(np.array([len(x) for x in found], np.int64)))
                ids.append(pack_numbers(np.array([i for x in found for i in x], np.int64)))
            columns = [batch.column("block"), batch.column("numbers"), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "numbers", "sizes", "ids"])

    return task


def _block_ids(lengths: bytes, places: bytes, found: pa.StructArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of the texts of a block, some texts at a time: where each text's begin (and the last ones end), and the ids."""
    none = [np.zeros(0, np.int32)]
    numbers, sizes, flat = (
        np.concatenate(none + [unpack_numbers(x, np.int32) for x in found.field(c).to_pylist()])
        for c in ("numbers", "sizes", "ids")
    )
    first = np.empty(len(numbers), np.int64)
    size = np.empty(len(numbers), np.int32)
    first[numbers] = np.cumsum(sizes) - sizes
    size[numbers] = sizes
    words = unpack_numbers(places, np.int32)
    text_ends = np.concatenate([[0], np.cumsum(unpack_numbers(lengths))])
    at = 0
    while at < len(text_ends) - 1:
        # texts of about PUT_WORDS words (one at least)
        end = max(at + 1, int(np.searchsorted(text_ends, text_ends[at] + PUT_WORDS, side="right")) - 1)
        word = words[text_ends[at] : text_ends[end]]
        n = size[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        yield ends[text_ends[at : end + 1] - text_ends[at]], flat[np.repeat(first[word] - ends[:-1], n) + np.arange(ends[-1])]
        at = end


def _reassemble_task(names: list[str]):
    def task(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                lengths, places = (batch.column(c)[at].as_buffer() for c in ("lengths", "places"))
                carried, done = batch.column("carried")[at].values, 0
                for ends, ids in _block_ids(lengths, places, batch.column("found")[at].values):
                    part = carried.slice(done, len(ends) - 1)
                    done += len(part)
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([*part.flatten(), lists], names)
        pa.default_memory_pool().release_unused()

    return task


def _plain(df: DataFrame) -> tuple[list[str], list[str]]:
    """Names for the columns inside tasks (dots and cases cannot clash there), and their types."""
    return [f"c{i}" for i in range(len(df.columns))], [f.dataType.simpleString() for f in df.schema.fields]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``ids array<int>``: the token ids of each whole text."""
    ship_package(docs.sparkSession)
    rest = drop_columns(docs, [text_col, "ids"])
    marker = own_name(rest, "_row")  # a block's rows have one column at least
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    source = docs.select(*[F.col(quoted(c)) for c in rest.columns], F.lit(True).alias(marker), text.alias("text"))
    plain, types = _plain(source)
    plain, types = plain[:-1], types[:-1]
    struct = ", ".join(f"{n}: {t}" for n, t in zip(plain, types, strict=True))
    schema = f"block long, lengths binary, places binary, parts {PARTS}, carried array<struct<{struct}>>"
    cut = source.toDF(*plain, "text").mapInArrow(_blocks_task(pattern), schema)
    blocks = written_buckets(cut, "bpe-blocks", "block")
    words = blocks.select("block", F.inline("parts")).repartition("bucket").sortWithinPartitions("bucket")
    coded = words.mapInArrow(_encode_task(path, pattern), "block long, numbers binary, sizes binary, ids binary")
    found = coded.groupBy("block").agg(F.collect_list(F.struct("numbers", "sizes", "ids")).alias("found"))
    none = F.array().cast("array<struct<numbers: binary, sizes: binary, ids: binary>>")
    whole = blocks.drop("parts").join(found, "block", "left").withColumn("found", F.coalesce("found", none))
    out_schema = ", ".join([*(f"{n} {t}" for n, t in zip(plain, types, strict=True)), "ids array<int>"])
    out = whole.select("lengths", "places", "found", "carried").mapInArrow(_reassemble_task([*plain, "ids"]), out_schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(plain, rest.columns, strict=False)], "ids")


def concatenated(ids: np.ndarray, table: pa.BinaryArray) -> bytes:
    """The entries of ``table`` at ``ids``, one after another."""
    if not len(ids):
        return b""
    taken = table.take(pa.array(ids))
    _, ends, data = taken.buffers()
    return data.slice(0, int(np.frombuffer(ends, np.int32)[len(taken)])).to_pybytes() if data else b""


def _decode_task(shared, names: list[str], with_digest: bool):
    def task(batches):
        table, known = shared.value
        texts = pa.array([b"%d," % i for i in range(len(known))], pa.binary()) if with_digest else None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column("ids")
                ends = lists.offsets.to_numpy()
                ids = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
                if len(ids) and not (ids.min() >= 0 and ids.max() < len(known) and known[ids].all()):
                    raise ValueError("an id is not in the token-byte table")
                each = [ids[a:b] for a, b in zip(ends - ends[0], ends[1:] - ends[0], strict=False)]
                columns = [*part.columns[:-1], pa.array([concatenated(x, table) for x in each], pa.binary())]
                if with_digest:
                    digests = [hashlib.sha256(concatenated(x, texts)[:-1]).hexdigest() for x in each]
                    columns.append(pa.array(digests, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return task


def byte_array(tokens: DataFrame) -> tuple[pa.BinaryArray, np.ndarray]:
    """The table ``(id, bytes)`` as an array by id, and which ids it has."""
    rows = {r["id"]: bytes(r["bytes"]) for r in tokens.select("id", "bytes").collect()}
    known = np.zeros(max(rows, default=-1) + 1, bool)
    known[list(rows)] = True
    return pa.array([rows.get(i, b"") for i in range(len(known))], pa.binary()), known


def decode(rows: DataFrame, tokens: DataFrame, ids_col: str = "ids", digest_col: str | None = None) -> DataFrame:
    """``rows`` without the ids, with ``decoded binary``: the bytes of each row's ids by the table ``(id, bytes)``.

    ``tokens`` is a tokenizer's vocabulary (some hundred thousand rows at most), so it is broadcast.
    ``digest_col`` names a column for the SHA-256 of the decimal ids joined by commas.
    """
    spark = rows.sparkSession
    ship_package(spark)
    added = ["decoded", *([digest_col] if digest_col else [])]
    rest = drop_columns(rows, [ids_col, *added])
    plain, types = _plain(rest)
    columns = [F.col(quoted(c)).alias(n) for c, n in zip(rest.columns, plain, strict=True)]
    ids = F.coalesce(F.col(quoted(ids_col)).cast("array<int>"), F.array().cast("array<int>"))
    kinds = [*(f"{n} {t}" for n, t in zip(plain, types, strict=True)), "decoded binary", *(["digest string"] if digest_col else [])]
    names = [k.split(" ", 1)[0] for k in kinds]
    shared = spark.sparkContext.broadcast(byte_array(tokens))
    task = _decode_task(shared, names, digest_col is not None)
    out = rows.select(*columns, ids.alias("ids")).mapInArrow(task, ", ".join(kinds))
    return out.toDF(*rest.columns, *added)
