"""Ranked lexical search: the best documents of every item, by dual-tree search.

A term's weight falls with the share of documents that hold it; a document's
part for a term (its *impact*) grows with the term's occurrences and falls with
the document's length against the mean.  All scores are integers.

Documents are read once into blocks: a row a block with its terms and, for
each term, the documents that hold it.  Items are worked off in batches of at
most ``BATCH_TERMS`` terms in all, so what is broadcast and what the driver
holds has that bound whatever the number of items or documents.  For a batch:

* the documents with each of its terms are counted over all blocks;
* each item's most promising block (the largest bound) is searched first, which
  gives every item a score that its k-th best reaches at least;
* all blocks are searched.  In a task both sides are trees: documents that
  share their weightiest term stand together in leaves of ``DOC_LEAF``, items
  likewise in leaves of ``ITEM_LEAF``, ``ARITY`` nodes to a parent.  A node holds
  the coordinate maxima of its members: the largest weight, or impact, of each
  term.  The product of two nodes' maxima bounds the score of each pair below
  them, so if it is less than the weakest k-th score of the node's items, the
  whole batch of pairs goes.  What remains is scored exactly.

The result is exact: a pair goes only if its score is below ``k`` others.
The tasks' best rows are ranked by item at the end, at most ``k`` an item and
task; the blocks need no shuffle.

Defined results: a NULL text, and one without a term, matches nothing and does
not count as a document.  Rows with equal ids are documents of their own; equal
scores are ranked by ascending id, NULL ids last.  Items with equal ids are
ranked each for itself.  Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoframe.llm.common import quoted, ship_package, written
from spoframe.llm.packed import pack_numbers, unpack_numbers

#: A block ends at so many documents or characters.
BLOCK_DOCS, BLOCK_CHARS = 4096, 8_000_000
#: Terms of all items of a batch (one item may have more).
BATCH_TERMS = 200_000
DOC_LEAF, ITEM_LEAF, ARITY = 64, 16, 8

#: What stands in terms: digits, ASCII letters (lowered), and every byte of other characters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

BLOCK_SCHEMA = "block long, ids array<long>, lengths binary, terms array<string>, dfs binary, slots binary, counts binary"


def terms_of(text: Column) -> Column:
    """The distinct terms of a text (NULL: none); only A-Z are lowered."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)))


def _block(number: int, ids: list, texts: list[str]) -> pa.RecordBatch:
    found = [text.encode().translate(_FOLD).split() for text in texts]
    lengths = np.array([len(x) for x in found], np.int64)
    coded = pa.array([w for words in found for w in words], pa.binary()).dictionary_encode()
    docs = np.repeat(np.arange(len(found)), lengths)
    keys, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * len(found) + docs, return_counts=True)
    return pa.RecordBatch.from_pydict(
        {
            "block": pa.array([number], pa.int64()),
            "ids": pa.array([ids], pa.list_(pa.int64())),
            "lengths": pa.array([pack_numbers(lengths)], pa.binary()),
            "terms": pa.array([coded.dictionary.cast(pa.string()).to_pylist()], pa.list_(pa.string())),
            "dfs": pa.array([pack_numbers(np.bincount(keys // len(found), minlength=len(coded.dictionary)))], pa.binary()),
            "slots": pa.array([pack_numbers(keys % len(found))], pa.binary()),
            "counts": pa.array([pack_numbers(counts)], pa.binary()),
        }
    )


def _blocks_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    ids: list = []
    texts: list[str] = []
    chars = 0
    for batch in batches:
        for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if texts and (len(texts) == BLOCK_DOCS or chars + len(text) > BLOCK_CHARS):
                yield _block(number, ids, texts)
                number, ids, texts, chars = number + 1, [], [], 0
            ids.append(doc_id)
            texts.append(text)
            chars += len(text)
    if texts:
        yield _block(number, ids, texts)


@dataclass
class _Batch:
    """Items of a batch: item ``i`` has the terms ``terms[starts[i]:starts[i + 1]]`` of the vocabulary."""

    keys: np.ndarray
    vocabulary: pa.Array
    terms: np.ndarray
    starts: np.ndarray
    weights: np.ndarray | None = None  # by term
    documents: int = 0
    occurrences: int = 0
    floor: np.ndarray | None = None  # by item: a score that its k-th best reaches


def _batch_of(rows: list) -> _Batch:
    coded = pa.array([t for r in rows for t in r["terms"]], pa.string()).dictionary_encode()
    starts = np.concatenate([[0], np.cumsum([len(r["terms"]) for r in rows])])
    keys = np.array([r["key"] for r in rows], np.int64)
    return _Batch(keys, coded.dictionary, coded.indices.to_numpy().astype(np.int64), starts)


def _number(weights: np.ndarray, starts: np.ndarray, terms: np.ndarray):
    """Doubles hold every sum of a batch exactly below 2**53; beyond it 64-bit integers do."""
    most = max((int(weights[terms[a:b]].sum()) for a, b in zip(starts, starts[1:], strict=False)), default=0)
    return np.float64 if most * 1_000_000 < 2**53 else np.int64


def _cells(batch: pa.RecordBatch, at: int, name: str) -> np.ndarray:
    return unpack_numbers(batch.column(name)[at].as_py())


def _df_task(shared):
    def task(batches):
        total = np.zeros(len(shared.value.vocabulary), np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                term = pc.index_in(batch.column("terms")[at].values, value_set=shared.value.vocabulary)
                known = term.is_valid().to_numpy(zero_copy_only=False)
                total[term.drop_null().to_numpy()] += _cells(batch, at, "dfs")[known]
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["term", "df"])

    return task


def _impacts(batch: pa.RecordBatch, at: int, b: _Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of a block's postings for the batch's terms: term, document and impact; and the number of documents."""
    lengths, dfs = _cells(batch, at, "lengths"), _cells(batch, at, "dfs")
    term = pc.fill_null(pc.index_in(batch.column("terms")[at].values, value_set=b.vocabulary), -1).to_numpy()
    of = np.repeat(term, dfs).astype(np.int64)
    use = of >= 0
    docs, tf = _cells(batch, at, "slots")[use], _cells(batch, at, "counts")[use]
    n = lengths if not len(lengths) or 50 * int(lengths.max()) * b.documents < 2**63 else lengths.astype(object)
    m = (50 + 50 * n * b.documents // b.occurrences).astype(np.int64)
    return of[use], docs, 1_000_000_000 * tf // (1000 * tf + 20 * m[docs]), len(lengths)


def _bounds_task(shared):
    """Each item's block with the largest bound among those of the task."""

    def task(batches):
        b: _Batch = shared.value
        best, block = np.zeros(len(b.keys), np.int64), np.zeros(len(b.keys), np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                term, _, impact, _ = _impacts(batch, at, b)
                most = np.zeros(len(b.vocabulary), np.int64)
                np.maximum.at(most, term, impact)
                bound = np.add.reduceat(np.append(b.weights[b.terms] * most[b.terms], 0), b.starts[:-1])
                better = bound > best
                best[better], block[better] = bound[better], batch.column("block")[at].as_py()
        has = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(block[has]), pa.array(best[has])], ["item", "block", "bound"])

    return task


class _Tree:
    """Sparse coordinate maxima: ``levels[0]`` of the leaves, then of ever ``ARITY`` nodes, up to one root.

    A level is ``(term, value, starts)``: node ``j`` has the coordinates
    ``starts[j]:starts[j + 1]``.
    """

    def __init__(self, term: np.ndarray, value: np.ndarray, leaf: np.ndarray, leaves: int, vocabulary: int):
        self.levels = []
        node, count = leaf, leaves
        while True:
            key = node * vocabulary + term
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            value = np.maximum.reduceat(value, first) if len(first) else value
            node, term = key[first] // vocabulary, key[first] % vocabulary
            self.levels.append((term, value, np.searchsorted(node, np.arange(count + 1))))
            if count == 1:
                return
            node, count = node // ARITY, -(-count // ARITY)

    def nodes(self, level: int) -> int:
        return len(self.levels[level][2]) - 1


def _children(nodes: np.ndarray, below: int) -> np.ndarray:
    out = (nodes[:, None] * ARITY + np.arange(ARITY)).ravel()
    return out[out < below]


def _slices(starts: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates of some nodes one after another, and where each node's begin (and the last ones end)."""
    n = starts[nodes + 1] - starts[nodes]
    ends = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(starts[nodes] - ends[:-1], n) + np.arange(ends[-1]), ends


def _together(term: np.ndarray, value: np.ndarray, member: np.ndarray, members: int) -> np.ndarray:
    """Places of the members in an order by their weightiest term, so that like ones share a leaf."""
    order = np.lexsort((term, -value, member))
    first = np.flatnonzero(np.append(True, member[order][1:] != member[order][:-1])) if len(order) else order
    top = np.full(members, -1, np.int64)
    top[member[order][first]] = term[order][first]
    place = np.empty(members, np.int64)
    place[np.argsort(top, kind="stable")] = np.arange(members)
    return place


class _Search:
    """The best documents of a batch's items in the blocks that a task sees."""

    def __init__(self, b: _Batch, k: int):
        self.b, self.k = b, k
        self.number = _number(b.weights, b.starts, b.terms)
        n = len(b.keys)
        member = np.repeat(np.arange(n), np.diff(b.starts))
        weight = b.weights[b.terms]
        self.place = _together(b.terms, weight, member, n)
        self.items = np.argsort(self.place)  # item by place
        self.tree = _Tree(b.terms, weight, self.place[member] // ITEM_LEAF, -(-n // ITEM_LEAF), len(b.vocabulary))
        self.floor = np.maximum(b.floor, 1)[self.items]  # by place: the least score that may matter
        self.best: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        self.weights = np.zeros(len(b.vocabulary), np.int64)
        self.pairs = self.scored = 0

    def block(self, batch: pa.RecordBatch, at: int) -> None:
        term, doc, impact, n = _impacts(batch, at, self.b)
        if not len(term):
            return
        place = _together(term, self.b.weights[term] * impact, doc, n)
        doc = place[doc]
        leaves = -(-n // DOC_LEAF)
        self.docs = _Tree(term, impact, doc // DOC_LEAF, leaves, len(self.b.vocabulary))
        order = np.argsort(doc // DOC_LEAF, kind="stable")
        self.term, self.doc, self.impact = term[order], doc[order], impact[order].astype(self.number)
        self.leaf = np.searchsorted(doc[order] // DOC_LEAF, np.arange(leaves + 1))
        ids = batch.column("ids")[at].values
        by_place = np.argsort(place)
        self.null = ids.is_null().to_numpy(zero_copy_only=False)[by_place]
        self.ids = pc.fill_null(ids, 0).to_numpy()[by_place]
        self.pairs += n * len(self.items)
        self._visit(len(self.tree.levels) - 1, 0, len(self.docs.levels) - 1, np.array([0]))

    def _visit(self, level: int, item_node: int, doc_level: int, nodes: np.ndarray) -> None:
        """Bound an item node against document nodes, and go on with what remains on both sides."""
        terms, values, starts = self.tree.levels[level]
        mine = slice(starts[item_node], starts[item_node + 1])
        self.weights[terms[mine]] = values[mine]
        doc_terms, maxima, doc_starts = self.docs.levels[doc_level]
        at, ends = _slices(doc_starts, nodes)
        products = np.append(self.weights[doc_terms[at]] * maxima[at], 0)
        bounds = np.where(np.diff(ends) > 0, np.add.reduceat(products, ends[:-1]), 0)
        self.weights[terms[mine]] = 0
        span = ITEM_LEAF * ARITY**level
        weakest = self.floor[item_node * span : (item_node + 1) * span].min()
        left = bounds >= weakest
        nodes, bounds = nodes[left], bounds[left]
        if not len(nodes):
            return
        if level == 0 and doc_level == 0:
            order = np.argsort(-bounds, kind="stable")
            self._score(item_node, nodes[order], bounds[order])
            return
        if doc_level:
            nodes, doc_level = _children(nodes, self.docs.nodes(doc_level - 1)), doc_level - 1
        if level:
            for child in _children(np.array([item_node]), self.tree.nodes(level - 1)).tolist():
                self._visit(level - 1, child, doc_level, nodes)
        else:
            self._visit(0, item_node, doc_level, nodes)

    def _score(self, item_node: int, nodes: np.ndarray, bounds: np.ndarray) -> None:
        """Exact scores of a leaf of items in leaves of documents, the most promising first."""
        first = item_node * ITEM_LEAF
        items = self.items[first : first + ITEM_LEAF]
        b = self.b
        own = [b.terms[b.starts[i] : b.starts[i + 1]] for i in items]
        union = np.unique(np.concatenate(own))
        matrix = np.zeros((len(items), len(union)), self.number)
        for row, terms in enumerate(own):
            matrix[row, np.searchsorted(union, terms)] = b.weights[terms]
        column = np.full(len(b.vocabulary), -1, np.int64)
        column[union] = np.arange(len(union))
        floor = self.floor[first : first + len(items)]
        for node, bound in zip(nodes.tolist(), bounds.tolist(), strict=True):
            if bound < floor.min():
                return  # so are all that follow
            cut = slice(self.leaf[node], self.leaf[node + 1])
            at = column[self.term[cut]]
            use = at >= 0
            impacts = np.zeros((len(union), DOC_LEAF), self.number)
            impacts[at[use], self.doc[cut][use] - node * DOC_LEAF] = self.impact[cut][use]
            scores = (matrix @ impacts).astype(np.int64)
            self.scored += len(items) * DOC_LEAF
            hits = scores >= floor[:, None]
            for row in np.flatnonzero(hits.any(1)).tolist():
                found = np.flatnonzero(hits[row])
                self._add(first + row, scores[row, found], found + node * DOC_LEAF)

    def _add(self, place: int, scores: np.ndarray, docs: np.ndarray) -> None:
        best = self.best[place]
        best.append((scores, self.null[docs], self.ids[docs]))
        if sum(len(s) for s, _, _ in best) >= self.k:
            score, null, ids = (np.concatenate(x) for x in zip(*best, strict=True))
            order = np.lexsort((ids, null, -score))[: self.k]
            best[:] = [(score[order], null[order], ids[order])]
            self.floor[place] = max(self.floor[place], score[order[-1]])

    def rows(self) -> Iterator[pa.RecordBatch]:
        for place, best in enumerate(self.best):
            if best:
                score, null, ids = (np.concatenate(x) for x in zip(*best, strict=True))
                key = np.full(len(score), self.b.keys[self.items[place]])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids, mask=null), pa.array(score)], ["key", "doc_id", "score"])


def _search_task(shared, k: int):
    def task(batches):
        search = _Search(shared.value, k)
        for batch in batches:
            for at in range(batch.num_rows):
                search.block(batch, at)
        yield from search.rows()

    return task


def document_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents as written blocks: a row a block with its terms' documents and occurrences."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    return written(source.mapInArrow(_blocks_task, BLOCK_SCHEMA), "lexical-blocks")


def _totals_task(batches):
    n = occurrences = 0
    for batch in batches:
        for at in range(batch.num_rows):
            lengths = _cells(batch, at, "lengths")
            n, occurrences = n + int((lengths > 0).sum()), occurrences + int(lengths.sum())
    yield pa.RecordBatch.from_pydict({"n": [n], "occurrences": [occurrences]})


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per item its ``k`` best documents with a score above 0: ``item_id, rank, doc_id, score``."""
    spark = docs.sparkSession
    blocks = document_blocks(docs, id_col, text_col)
    totals = blocks.select("lengths").mapInArrow(_totals_task, "n long, occurrences long")
    total = totals.agg(F.sum("n").alias("n"), F.sum("occurrences").alias("occurrences")).first()
    named = items.select(F.col(quoted(item_col)).alias("item_id"), terms_of(F.col(quoted(text_col))).alias("terms"))
    queries = written(named.withColumn("key", F.monotonically_increasing_id()).where(F.size("terms") > 0), "lexical-items")
    size = queries.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    schema = "key long, doc_id long, score long"
    results = [spark.createDataFrame([], schema + ", rank int")]
    batches = -(-size // BATCH_TERMS) if total["n"] else 0
    for number in range(batches):
        mine = queries.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == number).select("key", "terms").collect()
        if not mine:
            continue
        b = _batch_of(mine)
        b.documents, b.occurrences = total["n"], total["occurrences"]
        shared = spark.sparkContext.broadcast(b)
        counts = blocks.select("terms", "dfs").mapInArrow(_df_task(shared), "term long, df long")
        df = np.zeros(len(b.vocabulary), np.int64)
        for r in counts.groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of the batch at most
            df[r["term"]] = r["df"]
        shared.unpersist()
        b.weights = np.array([math.floor(1000 * math.log((2 * b.documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        b.floor = np.zeros(len(b.keys), np.int64)
        shared = spark.sparkContext.broadcast(b)
        bounds = blocks.mapInArrow(_bounds_task(shared), "item long, block long, bound long")
        promising = bounds.groupBy("item").agg(F.max_by("block", F.struct("bound", "block")).alias("block")).select("block")
        first = blocks.join(written(promising.distinct(), "lexical-first"), "block", "left_semi").select(*blocks.columns)
        seeds = _best(first.mapInArrow(_search_task(shared, k), schema), k).where(F.col("rank") == k)
        place = {key: i for i, key in enumerate(b.keys.tolist())}
        for r in seeds.select("key", "score").collect():  # a row an item of the batch at most
            b.floor[place[r["key"]]] = r["score"]
        shared.unpersist()
        shared = spark.sparkContext.broadcast(b)
        results.append(written(_best(blocks.mapInArrow(_search_task(shared, k), schema), k), "lexical-best"))
        shared.unpersist()
    whole = results[0]
    for r in results[1:]:
        whole = whole.unionByName(r)
    return whole.join(queries.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")
