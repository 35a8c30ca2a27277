"""Small brute-force and edge-case checks of the corpus operators."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spoframe.llm import (
    license_scan, line_dedup, mixing, ngram_join, packing, quality_rules, suffix_dedup, syncmers, warc,
)
from spoframe.llm.queries import tokenizer_path
from spoframe.llm.token_rollup import CHANGES, TokenRollup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, tokens string"
WORDS = [f"w{i}" for i in range(40)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y") for i, t in rows], DOCS)


def random_rows(seed, n=60):
    """Texts, near copies, exact copies, repeated rows, empty, NULL and white-space texts."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            words = (rng.choice(rows)[1] or "a").split()
            if words and rng.random() < 0.6:
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 80)))))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n\t "), rows[3], (n + 3, "A é漢 " * 50)]


def test_quality_stats_and_rules(spark):
    rows = [(i, t) for i, t in random_rows(1)] + [(900, "x " * 50), (901, "a\nb\n\na\n a"), (902, "<#> &| é")]
    out = quality_rules.with_text_stats(docs_of(spark, rows))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")] + quality_rules.COUNTS
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.collect())

    def expected(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        covered = {k + j for k, w in enumerate(windows) if w in twice for j in range(8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))

    assert got == Counter((i, *expected(t)) for i, t in rows)
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.fit_rules(out, no_labels).rules == ()
    junk = [(i, ("@!# " if i % 2 else "word other ") * 15 + str(i)) for i in range(200)]
    stats = quality_rules.with_text_stats(docs_of(spark, junk)).drop("kept")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    found = quality_rules.quality_verdicts(stats, quality_rules.fit_rules(stats, labels)).collect()
    assert all((r.rule is not None) == (r.doc_id % 2 == 1) for r in found)


def test_line_dedup(spark):
    rows = [(i, "menu\n\nbody %d\nmenu" % i, "a") for i in range(10)] + [(20, None, "a"), (21, "menu", None), (22, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_dropped_lines) for r in line_dedup.drop_boilerplate(docs, max_ratio=0.5).collect()}
    assert got[3] == ("\nbody 3", 2)
    assert got[20] == (None, 0) and got[21] == ("menu", 0) and got[22] == ("", 0)
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0


@pytest.mark.parametrize("narrow", [32, 1])
def test_ngram_jaccard_matches_brute_force(spark, narrow):
    rows = random_rows(7, 120)
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    label = {}
    for i, (doc, _) in enumerate(rows):
        label[root(i)] = min(label.get(root(i), doc), doc)
    expected = Counter((d, len(sets[i]), label[root(i)]) for i, (d, _) in enumerate(rows))
    got = ngram_join.jaccard_components(docs_of(spark, rows), narrow=narrow, tile=8)
    assert Counter(tuple(r) for r in got.collect()) == expected


def test_syncmers(spark):
    rows = [(1, "a b c d e f g h i j " * 5), (2, "a b c d e f g h i j " * 5), (3, None), (4, "one two"), (None, "x y z")]
    docs = syncmers.with_anchors(docs_of(spark, rows), "text", "kept")
    got = {r.doc_id: r.kept for r in docs.collect()}
    assert got[1] == got[2] and got[3] == [] and len(got[4]) == 1
    near = syncmers.with_next(docs, "doc_id", {"next": "doc_id"}, rows_per_bucket=2)
    assert {r.doc_id: r.next for r in near.collect()} == {4: 3, 3: 2, 2: 1, 1: None, None: 4}
    pair = docs.crossJoin(docs.select(F.col("doc_id").alias("d2"), F.col("kept").alias("k2")))
    like = {(r.doc_id, r.d2): r.x for r in pair.withColumn("x", syncmers.likeness(F.col("kept"), F.col("k2"))).collect()}
    assert like[1, 2] == 1.0 and like[3, 3] == 1.0 and like[3, 4] == 0.0


def test_syncmers_of_short_texts(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.sample(WORDS, 5 + i % 4))) for i in range(200)]
    docs = syncmers.with_anchors(docs_of(spark, rows), "text", "kept").select("doc_id", "kept")
    got = {r.doc_id: tuple(r.kept) for r in docs.collect()}
    assert all(got.values())
    assert len(set(got.values())) == len({t for _, t in rows})
    pair = docs.crossJoin(docs.select(F.col("doc_id").alias("d2"), F.col("kept").alias("k2"))).filter("doc_id < d2")
    assert pair.filter(syncmers.likeness(F.col("kept"), F.col("k2")) == 1.0).count() == 0


def test_warc_round_trip_in_chunks(spark):
    pages = [(1, "u\r\n1", "é" * 100), (2, None, "é" * 100), (3, "u", None), (None, "u", "é" * 100), (5, "u", "WARC/1.1\r\n\r\n" * 3)]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    records = warc.plan_records(docs)
    manifest = warc.write_warc(warc.chunk_table(records, 7), warc.fresh_path(spark, "warc"), roll_bytes=300)
    rows = warc.read_warc(manifest, chunk_bytes=11).orderBy("record_id", "chunk_no").collect()
    data = {}
    for r in rows:
        assert len(r.data) <= 11
        data[r.page_id] = data.get(r.page_id, b"") + r.data
        if r.record_type == "response":
            assert r.digest_so_far == hashlib.sha256(data[r.page_id]).hexdigest()
    last = {r.page_id: r for r in rows if r.last}
    assert data[1] == ("é" * 100).encode() and data[2] == b"" and data[5] == pages[4][2].encode()
    assert [(last[i].record_type, last[i].refers_to) for i in (1, 2, 3, None, 5)] == [
        ("response", None), ("revisit", 1), ("response", None), ("revisit", 1), ("response", None)
    ]
    assert last[2].payload_bytes == 200 and last[2].payload_digest == last[1].payload_digest


def test_mixing(spark):
    rows = [(i, ("good fine text number %d " if i % 3 else "bad awful words %d ") % i * 4) for i in range(90)] + [(90, None), (None, "x")]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, "keep" if i % 3 else "drop") for i in range(60)] + [(None, "keep")], "doc_id long, domain string")
    model = mixing.fit_domains(docs, labels)
    scored = mixing.score(docs.select("doc_id", "text"), model)
    totals = [0.0 if d == "drop" else 60 * 20.0 for d in model.domains]
    got = {r.doc_id: r.rate for r in mixing.with_rates(scored, mixing.fit_rates(scored, totals, high=1.0)).collect()}
    assert all((got[i] > 0.9) == (i % 3 > 0) for i in range(90)) and len(got) == 92
    none = mixing.fit_domains(docs, labels.limit(0))
    plain = mixing.score(docs.select("doc_id", "text"), none)
    assert {r.copies for r in mixing.with_rates(plain, mixing.fit_rates(plain, [])).collect()} == {1}


@pytest.mark.parametrize("share, sure", [(0.001, 0.999), (0.002, 0.98), (0.005, 0.995), (0.1, 0.99)])
def test_mixing_rare_domain(spark, share, sure):
    n, rare = 10_000, round(10_000 * share)
    rows = [(i, 100, [1 - sure, sure] if i < rare else [1.0, 0.0]) for i in range(n)]
    scored = spark.createDataFrame(rows, "doc_id long, tokens long, posteriors array<double>")
    clean = sum(t * p[0] for _, t, p in rows)
    mix = mixing.fit_rates(scored, [clean, 0.0], high=1.0)
    toxic, kept = mix.rates(np.array([rows[0][2], rows[-1][2]]))
    assert toxic < 0.02 and kept > 0.98
    copies = {(r.doc_id < rare, r.copies) for r in mixing.with_rates(scored, mix).collect()}
    assert copies == {(True, 0), (False, 1)}


def test_mixing_is_optimal(spark):
    rng = np.random.default_rng(5)
    p = np.vstack([rng.dirichlet([8, 1, 0.1], 300), rng.dirichlet([1, 6, 0.3], 80), rng.dirichlet([0.3, 0.3, 9], 3)])
    t = rng.integers(1, 500, len(p)).astype(float)
    own = t @ p
    scored = spark.createDataFrame([(i, int(a), [float(y) for y in x]) for i, (a, x) in enumerate(zip(t, p))], "doc_id long, tokens long, posteriors array<double>")
    for targets, high in (([0.97, 0.02, 0.01], 4.0), ([0.5, 0.1, 0.4], 4.0), (None, 1.0)):
        wanted = np.array([own[0], 0, 0]) if targets is None else np.array(targets) * t.sum()
        mix = mixing.fit_rates(scored, list(wanted), high=high)
        r = mix.rates(p)
        w = (np.array(mix.totals) - wanted) / own
        assert np.allclose(mix.totals, (t * r) @ p)
        # no rate can move to where the objective is smaller
        gradient = p @ w + 1e-3 * (r - 1)
        assert np.all(np.abs(r - np.clip(r - gradient, 0, high)) < 1e-3)


def test_pipeline_mix_gives_each_row_its_own_rate(spark, tmp_path):
    good, bad = "good fine text number %d " * 4, "bad awful words %d " * 4
    rows = [(i, (good if i % 3 else bad) % ((i,) * 4)) for i in range(300)]
    rows += [(None, good % ((901,) * 4)), (None, good % ((901,) * 4)), (500, good % ((902,) * 4)), (None, None)]
    toxic = [(None, bad % ((k,) * 4)) for k in range(903, 908)] + [(500, bad % ((909,) * 4))]
    labels = [(i, int(i % 3 == 0), 1) for i in range(300)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.mix(spark, docs_of(spark, rows + toxic), str(tmp_path))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    got = Counter((r.doc_id, r.text) for r in out.collect() if r.text is not None)
    assert got == Counter((i, t) for i, t in rows if t is not None and "good" in t)


def test_token_rollup(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path / "r"))
    change = lambda *rows: spark.createDataFrame(list(rows), CHANGES)
    assert rollup.totals().count() == 0
    assert rollup.commit("a", change(("insert", 1, "s", None, "t", 10), ("insert", 2, "s", None, "t", 5), ("insert", None, "s", "en", "t", None)))
    assert not rollup.commit("a", change(("insert", 3, "s", "en", "t", 10)))
    assert rollup.commit("b", change(("revise", 1, "z", "en", "t", 7), ("delete", 2, None, None, "t", 0), ("delete", 9, "s", "en", "t", 1)))
    got = sorted((r.source, str(r.lang), r.documents, r.tokens) for r in rollup.totals().collect())
    assert got == [("s", "en", 1, 0), ("z", "en", 1, 7)]
    copy = rollup.compact(str(tmp_path / "c"))
    assert not copy.commit("b", change(("insert", 3, "s", "en", "t", 10)))
    assert sorted((r.source, str(r.lang), r.documents, r.tokens) for r in copy.totals().collect()) == got


def test_suffix_dedup_matches_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcé ") for _ in range(400)) for _ in range(4)]
    rows = []
    for i in range(40):
        a, b = (x[k : k + rng.randint(60, 300)] for x in rng.choices(base, k=2) for k in [rng.randint(0, 99)])
        rows.append((i, a + rng.choice(["", "#", b[:50]]) + b))
    rows += [(40, rows[3][1]), (41, None), (42, "short"), (43, "short"), (44, "ab" * 200)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs_of(spark, rows)).collect()}
    seen = set()
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(data[k : k + 100])
        assert bytes(got[i].kept) == bytes(np.frombuffer(data, np.uint8)[~gone]), i
        assert (got[i].n_bytes, got[i].n_removed) == (len(data), int(gone.sum()))


def kept_by_brute_force(rows, least=100):
    seen, out = set(), {}
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - least + 1):
            if data[k : k + least] in seen:
                gone[k : k + least] = True
            seen.add(data[k : k + least])
        out[i] = bytes(np.frombuffer(data, np.uint8)[~gone])
    return out


def test_suffix_dedup_contexts_hold_only_what_may_repeat(spark, monkeypatch):
    rng = random.Random(21)
    junk = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    base = junk(600)
    # a passage of 100 to 140 bytes between other text, with periods of a range's width, and with an edit anywhere
    rows = [(0, base)]
    rows += [(i, junk(rng.randint(0, 90)) + base[k : k + rng.randint(100, 140)] + junk(rng.randint(0, 90))) for i, k in ((i, rng.randint(0, 460)) for i in range(1, 40))]
    period, long = junk(17), junk(34)
    rows += [(40, period * 12), (41, junk(30) + period * 9 + junk(20)), (42, long * 7), (43, long[5:] + long * 4), (44, "a" * 130)]
    rows += [(45 + j, base[:j] + "#" + base[j + 1 :]) for j in range(120, 480, 45)]
    sizes = []
    real = suffix_dedup._cut

    def recorded(blocks, wanted):
        out = real(blocks, wanted)
        sizes.extend(len(r["data"]) for r in out.select("data").collect())
        return out

    monkeypatch.setattr(suffix_dedup, "_cut", recorded)
    for hot in (2048, 4):
        got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs_of(spark, rows), hot_contexts=hot).collect()}
        assert got == kept_by_brute_force(rows)
    assert sizes and max(sizes) <= 168 and sum(x < 130 for x in sizes) > len(sizes) / 2


def test_suffix_dedup_splits_hot_anchors(spark, monkeypatch):
    rng = random.Random(9)
    junk = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    hot = {n: junk(n) for n in (32, 60, 99, 130)}
    shared = [junk(75) for _ in range(6)]
    rows = []
    for i in range(240):
        side = lambda: rng.choice([junk(90), junk(rng.randint(0, 60)), rng.choice(shared)])
        rows.append((i, side() + hot[rng.choice(sorted(hot))] + side()))
    rows += [(240, (hot[99] + "0") * 4), (241, rows[3][1]), (242, "ab" * 200)]
    most, made = 8, []
    real = suffix_dedup._split_hot

    def recorded(contexts, least, limit):
        blocks, covered = real(contexts, least, limit)
        made.append(max((r["count"] for b in blocks for r in b.groupBy("h").count().collect()), default=0))
        return blocks, covered

    monkeypatch.setattr(suffix_dedup, "_split_hot", recorded)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs_of(spark, rows), hot_contexts=most).collect()}
    assert made and 1 < made[0] <= most
    seen = set()
    for i, text in rows:
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(data[k : k + 100])
        assert bytes(got[i].kept) == bytes(np.frombuffer(data, np.uint8)[~gone]), i


def test_packing(spark):
    rng = random.Random(5)
    sizes = [rng.randint(1, 512) for _ in range(300)]
    window = packing.deal(sizes, 2048)
    sums = np.bincount(window, weights=sizes)
    assert sums.max() <= 2048 and len(sums) <= -(-sum(sizes) // 2048) + 2
    rows = [(1, "hello world " * 3000), (2, None), (None, ""), (3, "a <|endoftext|> b\x01c")] + [(i, "it's é " * i) for i in range(4, 40)]
    pieces = packing.pack(docs_of(spark, rows), tokenizer_path()).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    for i, text in rows:
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert b"".join(bytes(p.ids) for p in own) == ids.tobytes() and own[0].doc_tokens == len(ids)
    by = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == by.get(p.sequence_id, 0)
        by[p.sequence_id] = p.offset + p.length
    assert max(by.values()) <= 2048


def test_license_scan(spark):
    notice = license_scan.TEMPLATES["mit-grant"]
    rows = [(1, "x " * 77 + notice + " y" * 200), (2, None), (3, ""), (4, "Licensed under CC BY-NC 4.0."), (5, "the rights reserved for all")]
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs_of(spark, rows)).collect()}
    assert got == {(1, "mit-grant"), (4, "cc-by-nc-4.0-short")}


def test_tokenizer_equals_whole_texts():
    """Ids put together from pieces equal those of whole texts."""
    from tokenizers import Tokenizer

    from spoframe.llm.tokens import tokenizer

    texts = [
        "", " ", "\n", "One two, TWO. Three;: x!? end.", "a\x01b \x01 c. D", " lead. ", "tail ", "é. É, \U0001f600. x\n\ny\t z\r\n",
        "don't. 'S. it's! 3.5 4, (a). b) ., c", "E\u0301. I\u0307 K\u0301, \u212a. \u03a3\u03a3. A\u03a3 x", "A. B, C! D", "x. " * 3000,
    ]
    special = ["a <|endoftext|>. B <|ENDOFTEXT|> c"]
    whole = Tokenizer.from_file(tokenizer_path())
    for part in (texts, special, texts + special, []):
        want = [np.array(x.ids, "<u4").tobytes() for x in whole.encode_batch(part, add_special_tokens=False)]
        assert tokenizer(tokenizer_path()).ids(part) == want
