"""Whitening, lexical search and byte-level BPE against brute force, with the edge cases of their docstrings."""

import base64
import hashlib
import io
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from spoframe.llm import byte_bpe, lexical, whitening
from spoframe.llm.packed import pack_numbers, pack_words, unpack_numbers, unpack_words
from spoframe.llm.queries import queries

SF = "/root/testdata/sf0.001"


# -- embedding whitening ----------------------------------------------------


def white_brute(vectors, components=16):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = n * (fit.T @ fit) - np.outer(sums, sums)
    cov = (centred / (n * n)).astype(float)
    values, vecs = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    order = order[values[order] > len(cov) * np.finfo(float).eps * max(values.max(), 0)]
    dev = [n * np.array(r, dtype=object) - sums for r in x]
    out = np.array([[float(a) / n for a in d] for d in dev]) @ vecs[:, order] / np.sqrt(values[order])
    return n, [int((d**2).sum()) for d in dev], out, values[order] / np.trace(cov)


@pytest.mark.parametrize("spread", [1.0, 3000.0])
def test_whitening_is_exact(spark, spread):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 6)) @ rng.normal(size=(6, 6)) * spread
    vectors = [*base.tolist(), base[0].tolist(), base[1].tolist()]
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    bad = [(900, None, "x"), (901, [], "x"), (902, [1.0] * 5 + [None], "x"), (903, [math.nan] * 6, "x"), (904, [math.inf] * 6, "x"), (905, [1.0], "x")]
    df = spark.createDataFrame([*rows, *bad, (None, vectors[3], "x"), (3, vectors[3], "x")], "vec_id long, embedding array<double>, whitened string")
    model = whitening.fit_whitening(df, "embedding")
    got = whitening.whiten(df, "embedding", model).collect()
    vectors += [vectors[3]] * 2
    n, deviations, white, explained = white_brute(vectors)
    assert model.n == n and len(got) == len(vectors) and model.identity_error < 1e-9
    assert np.allclose(model.explained, explained, rtol=1e-9)
    ids = [*range(len(rows)), None, 3]
    found = sorted(((r.vec_id is None, r.vec_id or 0, int(r.deviation), r.whitened) for r in got))
    want = sorted(((i is None, i or 0, d, list(w)) for i, d, w in zip(ids, deviations, white, strict=True)))
    assert [f[:3] for f in found] == [w[:3] for w in want]
    a, b = (np.array([r[3] for r in rows_]) for rows_ in (found, want))
    signs = np.sign((a * b).sum(0))
    assert np.abs(a - b * signs).max() < 1e-8


def test_whitening_scatter_of_wide_values():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2**40, (300, 3))
    y[:, 1] = 0
    widths = [int(c.max()).bit_length() for c in y.T]
    limbs = whitening.scatter(whitening.planes(y, widths), widths)
    exact = y.astype(object).T @ y.astype(object)
    for i in range(3):
        for j in range(i, 3):
            assert sum(int(limbs[k, i, j]) << (whitening.LIMB * k) for k in range(len(limbs))) == exact[i, j]


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]):
        df = spark.createDataFrame(rows, schema)
        model = whitening.fit_whitening(df, "embedding")
        got = whitening.whiten(df, "embedding", model).collect()
        assert all(r.whitened == [] and r.deviation == 0 for r in got)
        assert len(got) == sum(v is not None for _, v in rows)


def test_op11_query(spark):
    rows = queries()["op11_whitening"](spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, deviations, white, explained = white_brute([r.embedding for r in table])
    assert len(rows) == 16 * len(table) and {r.n for r in rows} == {n}
    assert {(r.vec_id, r.deviation) for r in rows} == {(t.vec_id, d) for t, d in zip(table, deviations, strict=True)}
    assert all(abs(r.explained - explained[r.component - 1]) < 1e-9 and r.identity_error < 1e-9 for r in rows)


# -- ranked lexical search --------------------------------------------------


def rank_brute(docs, items, k):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(i, Counter(term.findall((t or "").translate(low)))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in found)
    total = sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in found:
            n, score = sum(c.values()), 0
            for t in set(term.findall((text or "").translate(low))):
                if c[t]:
                    m = 50 + 50 * n * n_docs // total
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return Counter(out)


def texts_for_search(seed, n=400):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "Lo", "é", "42", "漢") for b in range(60)]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 120)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "... !"), (3, docs[3][1]), (None, docs[5][1]), (n + 3, "ka1 " * 30_000)]
    docs += [(n + 10 + i, docs[7][1]) for i in range(40)]  # ties
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 30)))) for i in range(50)]
    return docs, [*items, (50, None), (51, ""), (52, "nowhere"), (3, "ka1 lo2"), (None, "é3, É3; 42-1")]


def test_search_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BATCH_TERMS", 200)  # several batches of items
    docs, items = texts_for_search(1)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("y"))
    for k in (1, 7, 1000):
        got = Counter(tuple(r) for r in lexical.search(d, q, k).collect())
        assert got == rank_brute(docs, items, k)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, items).count() == 0
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert lexical.search(one, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical.search(one, items).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 2000)))]


def test_nodes_are_pruned_and_nothing_is_lost():
    """Trees over clustered documents: most pairs are never scored, the best rows are exact."""
    rng = random.Random(3)
    texts = [" ".join(f"g{g}w{rng.randrange(40)}" for _ in range(60)) for g in range(10) for _ in range(100)]
    rows = [{"key": 16 * g + i, "terms": sorted({f"g{g}w{rng.randrange(40)}" for _ in range(8)})} for g in range(10) for i in range(16)]
    block = lexical._block(0, list(range(len(texts))), texts)
    b = lexical._batch_of(rows)
    b.documents, b.occurrences = len(texts), 60 * len(texts)
    held = [set(t.split()) for t in texts]
    df = [sum(t in h for h in held) for t in b.vocabulary.to_pylist()]
    b.weights = np.array([math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * x + 1))) for x in df])
    b.floor = np.zeros(len(rows), np.int64)
    search = lexical._Search(b, 50)
    search.block(block, 0)
    assert search.scored < 0.4 * search.pairs  # leaves part at neither 64 nor 100 documents
    got = Counter()
    for part in search.rows():
        got.update(zip(*(c.to_pylist() for c in part.columns), strict=True))
    items = [(r["key"], " ".join(r["terms"])) for r in rows]
    assert got == Counter((i, d, s) for i, _, d, s in rank_brute(list(enumerate(texts)), items, 50).elements())


# -- byte-level BPE ---------------------------------------------------------


def tokenizer():
    path, pattern = byte_bpe.vocabulary_file()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("brute", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def texts_for_bpe():
    rng = random.Random(2)
    chars = ["a", "Z", "é", "漢", "😀", " ", "  ", "\n", "\t", "\x00", " ", " ", "'s", "'LL", "'", "12", "٣", "!?", "<|endoftext|>", "́"]
    texts = ["".join(rng.choices(chars, k=rng.randint(1, 60))) for _ in range(200)]
    return [*texts, None, "", " ", "\n\n  x", "hello world " * 3, texts[0], "a" * 5000, "word " * 50_000]


def test_bpe_matches_tiktoken_and_decodes(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(byte_bpe, "CUT_CHARS", 500)
    coder, texts = tokenizer(), texts_for_bpe()
    rows = [(i % 300 if i % 7 else None, t, i, "n") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, IDS string").repartition(3)
    path, pattern = byte_bpe.vocabulary_file()
    coded = byte_bpe.encode(docs, path, pattern)
    assert coded.columns == ["doc_id", "a.b", "ids"]
    got = {r["a.b"]: r for r in coded.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].ids == coder.encode_ordinary(t or "") and got[i].doc_id == rows[i][0]
    tokens = byte_bpe.token_table(spark, path)
    back = {r["a.b"]: bytes(r.decoded) for r in byte_bpe.decode(coded, tokens).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_bpe_of_an_empty_table_and_unknown_ids(spark):
    path, pattern = byte_bpe.vocabulary_file()
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(none, path, pattern).count() == 0
    tokens = byte_bpe.token_table(spark, path)
    ids = spark.createDataFrame([(1, [0, 1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: len(r.decoded) for r in byte_bpe.decode(ids, tokens).collect()} == {1: 2, 2: 0, 3: 0}
    with pytest.raises(Exception, match="not in the token-byte table"):
        byte_bpe.decode(spark.createDataFrame([(1, [99_999_999])], "doc_id long, ids array<int>"), tokens).collect()


def test_op13_query(spark):
    coder = tokenizer()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = Counter()
    for r in docs:
        ids = coder.encode_ordinary(r.text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want[(r.doc_id, len(ids), digest, hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in queries()["op13_byte_bpe"](spark, SF).collect()) == want


def test_a_block_of_words_gives_its_texts_up(monkeypatch):
    class Task:
        def partitionId(self):
            return 0

    monkeypatch.setattr(byte_bpe.TaskContext, "get", staticmethod(Task))
    sink = io.BytesIO()
    text = " ".join("abcdefgh"[i] * 5000 for i in range(8)) * 25  # a million characters, few words
    schema = pa.schema([("c0", pa.int64()), ("text", pa.string())])
    with pa.ipc.new_stream(sink, schema) as out:
        for i in range(20):
            out.write_batch(pa.RecordBatch.from_pydict({"c0": [i], "text": [text]}, schema))
    sink.seek(0)
    held = []

    def batches():
        for batch in pa.ipc.open_stream(sink):
            yield batch
            del batch
            held.append(tracemalloc.get_traced_memory()[0])  # a batch's bytes come from Python's file

    tracemalloc.start()
    blocks = list(byte_bpe._blocks_task(byte_bpe.vocabulary_file()[1])(batches()))
    tracemalloc.stop()
    assert [x["c0"] for b in blocks for x in b.column("carried")[0].as_py()] == list(range(20))
    assert len(held) == 20 and max(held) < 8_000_000


def test_packed_cells():
    for kind in (np.int32, np.int64):
        x = np.array([0, 70_000, 3, (1 << 31) - 1], kind)
        assert unpack_numbers(pack_numbers(x), np.int32).tolist() == unpack_numbers(pack_numbers(x[::1])).tolist() == x.tolist()
        assert unpack_numbers(pack_numbers(x[::2]), np.int32).dtype == np.int32
    for x in ([], [0], [0, 255, 256], [2**40, 1], list(range(70_000))):
        assert unpack_numbers(pack_numbers(np.array(x, np.int64))).tolist() == x
    for words in ([], [b""], [b"a", b"", "é漢".encode()] * 9):
        assert unpack_words(pack_words(words)) == words


# -- mixing: copies meet the targets ----------------------------------------


def test_a_tokenizer_remembers_a_bounded_number_of_pieces(monkeypatch):
    from spoframe.llm import tokens
    from spoframe.llm.queries import tokenizer_path

    monkeypatch.setattr(tokens, "REMEMBERED", 500)
    bounded, fresh = tokens.WordTokenizer(tokenizer_path()), tokens.WordTokenizer(tokenizer_path())
    learned = []
    learn = bounded._learn
    monkeypatch.setattr(bounded, "_learn", lambda pieces: (learned.extend(pieces), learn(pieces)))
    for k in range(12):
        texts = [f"the word\n{k} " + " ".join(f"w{k}x{i}" for i in range(j, j + 50)) for j in range(0, 300, 50)]
        assert bounded.ids(texts) == fresh.ids(texts)
        assert len(bounded._known) + len(bounded._older) <= 2 * (500 + 400)
    # what is met again and again is kept when the rest is forgotten
    assert learned.count("the") == learned.count("word") == 1


def test_slices_hold_a_few_million_characters():
    from spoframe.llm.tokens import slices

    texts = ["x" * 1_000_000] * 5 + ["y" * 3_000_000, ""]
    cuts = list(slices(texts))
    assert [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and cuts[-1][1] == len(texts)
    assert all(sum(map(len, texts[a:b])) <= 2_000_000 or b == a + 1 for a, b in cuts)


def test_copies_meet_rare_targets(spark):
    from spoframe.llm import mixing

    rng = np.random.default_rng(8)
    lengths = np.minimum(np.exp(rng.normal(5, 1.5, 3000)), 20_000).astype(int) + 1
    p = np.where(rng.random(3000) < 0.05, 0.97, 0.0002)  # a domain of a twentieth, a few long documents in it
    rows = [(i if i % 5 else None, int(t), [1 - float(q), float(q)]) for i, (t, q) in enumerate(zip(lengths, p, strict=True))]
    scored = spark.createDataFrame(rows, "doc_id long, tokens long, posteriors array<double>")
    own = np.array([(lengths * (1 - p)).sum(), (lengths * p).sum()])
    for share in (0.04, 0.3, 0.77):
        wanted = [own[0], share * own[1]]
        mix = mixing.fit_rates(scored, wanted, high=2.0)
        got = mixing.with_rates(scored, mix, dead_band=0.0).collect()
        assert len(got) == len(rows) and all(abs(r.copies - r.rate) < 1 for r in got)
        copied = sum(r.tokens * r.copies * r.posteriors[1] for r in got)
        fitted = sum(r.tokens * r.rate * r.posteriors[1] for r in got)
        assert abs(fitted - wanted[1]) < 0.01 * own[1] and abs(copied - fitted) < 0.02 * wanted[1]


def test_a_fit_that_does_not_end_is_an_error(spark, monkeypatch):
    from spoframe.llm import mixing

    monkeypatch.setattr(mixing, "MAX_STEPS", 2)
    scored = spark.createDataFrame([(1, 10, [0.5, 0.5]), (2, 10, [0.9, 0.1])], "doc_id long, tokens long, posteriors array<double>")
    with pytest.raises(RuntimeError, match="not optimal"):
        mixing.fit_rates(scored, [20.0, 1.0])
