"""The pipeline's stages and the queries without SQL against plain Python, on small tables."""

import hashlib
import re
import shutil
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spoframe.llm import ngram_join, syncmers
from spoframe.llm.queries import queries, tokenizer_path
from spoframe.llm.token_rollup import CHANGES, TokenRollup
from spoframe.session import fresh_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size):
    w = words_of(fold(text))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def kept_by_hand(rows, size=5, percent=80):
    """Rows (doc_id, text) that stay: of each group the smallest id's; without words all."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same_set = sets[i] == sets[j]
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                if (rows[i][0] is not None and rows[j][0] is not None) or (same_set and rows[i] == rows[j]):
                    parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        if sets[i]:
            digest = hashlib.md5((text or "").encode()).digest()
            groups[root(i)].append((doc is None, doc or 0, digest, i))
    stay = [min(g) for g in groups.values()]
    texts_with_id = {rows[i][1] for i in range(len(rows)) if rows[i][0] is not None}
    out = [rows[i] for none, _, _, i in stay if not none or rows[i][1] not in texts_with_id]
    return Counter(out + [r for r, s in zip(rows, sets, strict=True) if not s])


def test_near_duplicates_keep_unique_rows(spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    near = long + " sixteen"
    other = "a wholly different text that shares no word with any of the former ones at all"
    rows = [
        (3, long), (5, long), (5, other), (5, other), (7, near), (7, "yet another text under the same id as a near copy"),
        (None, long), (None, "a text without an id"), (None, "a text without an id"), (9, ""), (9, ""), (None, None), (10, " \n"),
        (11, "short one"), (12, "Short ONE"), (-(2**63), near + " seventeen"), (2**63 - 1, "the largest id has a text"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], DOCS).withColumn("a.b", F.lit(1))
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == kept_by_hand(rows)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), SF).count() == 0


def test_one_of_each_on_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ngram_join.one_of_each(docs, size=5, percent=80)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == kept_by_hand(rows)


def test_quality_stage_returns_the_input_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns(
        {"kept": F.lit("x"), "n_words": F.lit("y"), "rule": F.lit(1.5), "a.b": F.lit(2)}
    )
    out = corpus_pipeline.quality(spark, docs, SF)
    assert out.dtypes == docs.dtypes
    verdicts = {r.doc_id: r.kept for r in queries()["op1_quality_rules"](spark, SF).collect()}
    rows = out.collect()
    assert {r.doc_id for r in rows} == {i for i, k in verdicts.items() if k}
    assert {(r.kept, r.n_words, r.rule, r["a.b"]) for r in rows} == {("x", "y", 1.5, 2)}


def lines_by_hand(rows):
    pages, count = Counter(r["source"] for r in rows), Counter()
    for r in rows:
        if r["text"] is not None and r["source"] is not None:
            count.update((r["source"], x) for x in set(r["text"].split("\n")) if words_of(x))
    bad = {k for k, n in count.items() if n >= 3 and n > 0.1 * pages[k[0]]}
    return [r | {"text": r["text"] and "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in bad)} for r in rows]


def test_whole_pipeline(spark):
    """Every stage of a run against plain Python, except what the classifiers decide."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF)
    rows = [r.asDict() for r in kept.collect()]
    assert 0 < len(rows) < docs.count()
    lined = corpus_pipeline.lines(spark, kept, SF)
    rows = lines_by_hand(rows)
    for r in rows:
        r["n_chars"] = None if r["text"] is None else len(r["text"])
    key = lambda r: tuple(r[c] for c in docs.columns)
    assert Counter(map(tuple, lined.collect())) == Counter(map(key, rows))
    unique = corpus_pipeline.near_duplicates(spark, lined, SF)
    want = kept_by_hand([(r["doc_id"], r["text"]) for r in rows])
    assert Counter((r.doc_id, r.text) for r in unique.collect()) == want
    mixed = corpus_pipeline.mix(spark, unique, SF)
    assert mixed.columns == docs.columns
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = Counter(r.doc_id for r in mixed.collect())
    clean = [i for i, _ in want if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
    toxic = [i for i, _ in want if i in labels and labels[i].toxic == 1]
    assert all(out[i] == 1 for i in clean) and not any(out[i] for i in toxic)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = defaultdict(list)
    for p in corpus_pipeline.pack(spark, mixed, SF).collect():
        pieces[p.doc_id].append((p.start, p.length, bytes(p.ids), p.doc_tokens))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert set(pieces) == set(texts)
    for doc, found in pieces.items():
        ids = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1]
        found.sort()
        assert [s for s, _, _, _ in found] == np.cumsum([0, *[n for _, n, _, _ in found]])[:-1].tolist()
        assert np.frombuffer(b"".join(x for _, _, x, _ in found), "<u4").tolist() == ids


def test_next_rows_of_wide_ids(spark):
    ids = [-(2**63), -9 * 10**18, 0, 5, 5, 9 * 10**18, 2**63 - 1, None]
    df = spark.createDataFrame([(i, f"t{k}", k) for k, i in enumerate(ids)], "doc_id long, text string, tie long")
    for size in (1, 2, 4000):
        got = {r.text: r.n for r in syncmers.with_next(df, "doc_id", {"n": "text"}, rows_per_bucket=size, tie_col="tie").collect()}
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, -(ids[k] or 0), k))
        assert got == {f"t{a}": f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_a_rollup_is_whole_in_its_folder(spark, tmp_path):
    folder, moved = str(tmp_path / "rollup"), str(tmp_path / "moved")
    rollup = TokenRollup(spark, folder)
    rollup.commit("a", spark.createDataFrame([("insert", 1, "s", "en", "v", 5), ("insert", 2, "s", "en", "v", 7)], CHANGES))
    rollup.commit("b", spark.createDataFrame([("revise", 1, "s", "en", "v", 6), ("delete", 2, None, None, "v", 0)], CHANGES))
    rollup.compact(str(tmp_path / "compact"))
    shutil.move(folder, moved)
    for where in (moved, str(tmp_path / "compact")):
        again = TokenRollup(spark, where)
        assert [tuple(r) for r in again.totals().collect()] == [("s", "en", "v", 1, 6)]
        assert not again.commit("a", spark.createDataFrame([("insert", 3, "s", "en", "v", 1)], CHANGES))
        assert again.commit("c", spark.createDataFrame([("insert", 3, "s", "en", "v", 1)], CHANGES))
        assert [tuple(r) for r in again.totals().collect()] == [("s", "en", "v", 2, 7)]


def test_op4_query(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: -r.doc_id)
    rows = {r.doc_id: r for r in queries()["op4_syncmers"](spark, SF).collect()}
    assert len(rows) == len(docs)
    for d, after in zip(docs, docs[1:] + docs[:1], strict=True):
        text, other, r = d.text or "", after.text or "", rows[d.doc_id]
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        if text == other:
            assert r.fingerprint == rows[after.doc_id].fingerprint and r.near_next == 1
    long = [rows[d.doc_id] for d in docs if len(words_of(d.text)) > 100]
    assert np.median([r.near_edited for r in long]) > 0.4 > 0.1 > np.median([r.near_next for r in long])


def test_op7_query(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    first = {}
    for d in docs:
        first[d.text or ""] = min(first.get(d.text or "", d.doc_id), d.doc_id)
    want = defaultdict(lambda: [0, 0])
    for d in docs:
        text = d.text or ""
        if d.doc_id == first[text]:
            marks = len(re.split(r"[.!?]+", text)) - 1
            counts = {"words-1": len(words_of(text)) + marks, "word-bpe-49k": len(tokenizer.encode(text, add_special_tokens=False).ids)}
            for version, n in counts.items():
                cell = want[(d.source, d.lang, version)]
                cell[0] += 1
                cell[1] += n
    got = {(r.source, r.lang, r.tokenizer): [r.documents, r.tokens] for r in queries()["op7_token_counts"](spark, SF).collect()}
    assert got == {k: v for k, v in want.items() if v != [0, 0]}


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_run_and_have_stable_columns(spark, name):
    df = queries()[name](spark, SF)
    path = fresh_path(spark, "query")
    df.write.parquet(path)
    assert spark.read.parquet(path).columns == df.columns
