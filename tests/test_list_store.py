"""Chunked lists: nothing lost, nothing whole in one row, the same answers as rows."""

import os
from collections import Counter

import pytest
from conftest import rows_of, triples_df

from spoframe.operators import Var, list_chunks, list_sizes, list_values, scan_star
from spoframe.plans import load_store, match

s, x, y, z = Var("s"), Var("x"), Var("y"), Var("z")


@pytest.mark.parametrize("k", [1_000, 1_001, 20_000])
def test_chunks_hold_every_value_once_with_its_count(spark, k):
    hub = spark.range(k).selectExpr("'hub' AS s", "'p' AS p", "concat('o', id) AS o")
    twice = hub.limit(10)
    small = triples_df(spark, [("t", "p", "a"), ("t", "p", "a"), ("t", "p", "b"), ("hub", "q", "a")])
    lists = list_chunks(hub.unionByName(twice).unionByName(small), chunk_values=1000)
    rows = lists.collect()
    assert len({(r.s, r.p, r.chunk) for r in rows}) == len(rows)
    assert all(r["values"] == sorted(set(r["values"])) and len(r["values"]) == len(r.counts) for r in rows)
    assert max(len(r["values"]) for r in rows) < 1_400  # about chunk_values each
    n = sum(len(r["values"]) for r in rows if r.s == "hub" and r.p == "p")
    assert n == k and Counter(sum((r.counts for r in rows if r.s == "hub" and r.p == "p"), [])) == Counter({1: k - 10, 2: 10})
    assert {(r.s, r.p): (r["values"], r.counts) for r in rows if r.s == "t"} == {("t", "p"): (["a", "b"], [2, 1])}
    assert {(r.s, r.p): r.n for r in list_sizes(lists).collect()} == {("hub", "p"): k + 10, ("t", "p"): 3, ("hub", "q"): 1}
    assert list_values(lists, "p").where("s = 't'").count() == 2


def test_one_value_without_end_is_one_entry(spark):
    rows = spark.range(50_000).selectExpr("'hub' AS s", "'p' AS p", "'same' AS o")
    got = list_chunks(rows).collect()
    assert [(r["values"], r.counts) for r in got] == [(["same"], [50_000])]


def test_known_short_lists_give_the_same_rows(spark):
    rows = [("hub", "p", f"o{i}") for i in range(30)] + [("t", "q", "a"), ("t", "q", "a"), ("t", "q", "b"), ("u", "r", "x")]
    t = triples_df(spark, rows)
    want = rows_of(list_chunks(t, chunk_values=10))
    assert rows_of(list_chunks(t, chunk_values=10, short=["q", "r"])) == want
    assert rows_of(list_chunks(t, ["q"], 10, short=["q"])) == [r for r in want if r[1] == "q"]
    assert rows_of(list_chunks(t, ["p", "q"], 10, short=["q"])) == [r for r in want if r[1] in "pq"]
    plan = list_chunks(t.repartition(2), ["q"], 10, short=["q"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1  # (the deal before it is dropped)


def test_empty_and_bad_arguments(spark):
    assert list_chunks(triples_df(spark, [])).count() == 0
    with pytest.raises(ValueError):
        list_chunks(triples_df(spark, []), chunk_values=0)


def test_stored_layout_answers_like_rows(spark, tmp_out):
    k = 5_000
    hub = spark.range(k).selectExpr("'hub' AS s", "'p' AS p", "concat('o', id) AS o")
    rest = [("hub", "q", "a"), ("t", "q", "a"), ("t", "p", "o1"), ("t", "p", "o2"), ("t", "p", "o2"), ("u", "q", "b"), ("o1", "r", "z")]
    triples = hub.unionByName(triples_df(spark, rest))
    store = load_store(triples, os.path.join(tmp_out, "store"), chunk_values=100)
    kinds = dict(store.property_table.dtypes)
    assert kinds == {"s": "string", "p": "bigint", "q": "string", "r": "string"}  # no cell holds a list
    assert {r.s: r.p for r in store.property_table.collect()} == {"hub": k, "t": 3, "u": None, "o1": None}
    queries = [
        ([(s, "p", x), (s, "q", y)], None),
        ([(s, "p", x), (s, "q", "a")], ["s"]),
        ([(s, "p", "o1"), (s, "q", y)], None),
        ([(s, "p", "o1")], None),
        ([(s, "p", "o1"), (s, "p", "o2")], None),
        ([(s, "p", x), (s, "p", "o2"), (x, "r", z)], None),
        ([(s, "p", x), (s, "p", y), (s, "q", "a"), (x, "r", z), (y, "r", z)], ["s", "x", "y"]),
        ([("hub", "p", x), ("hub", "q", y), (x, "r", z)], None),
        ([("hub", "p", "o1"), ("hub", "q", y)], None),
        ([("nobody", "p", x), ("nobody", "q", y)], None),
    ]
    # all variables of one star, lists with each value once: nothing to make distinct
    assert "Aggregate" not in match(store, queries[0][0], layout="mixed")._jdf.queryExecution().optimizedPlan().toString()
    for pats, select in queries:
        base = rows_of(match(store, pats, select, use_stats=False))
        for size in (1, 2):
            assert rows_of(match(store, pats, select, layout="mixed", min_group_size=size)) == base, pats


def test_a_star_of_lists_meets_a_hub_once(spark, tmp_out):
    k = 3_000
    hub = spark.range(k).selectExpr("'hub' AS s", "'p' AS p", "concat('o', id) AS o")
    marks = spark.range(k).selectExpr("'hub' AS s", "'q' AS p", "if(id % 3 = 0, 'b', 'a') AS o")
    store = load_store(hub.unionByName(marks), os.path.join(tmp_out, "store"), chunk_values=100)
    items = [("p", x), ("q", "a")]
    for rows in (store.rows, None):
        star = scan_star(store.property_table, store.pt_columns, s, items, lists=store.lists, rows=rows)
        assert star.count() == k  # not once for each of the 2,000 rows that hold the constant
    got = match(store, [(s, "p", x), (s, "q", "a")], ["x"], layout="mixed")
    assert sorted(r.x for r in got.collect()) == sorted(f"o{i}" for i in range(k))
