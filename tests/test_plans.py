"""What the plans do: existence tests, triangles, named tables, shared scans, one pass, file skipping."""

import os
import random
import re
import uuid

import pytest
from conftest import SF_SMALL, rows_of, triples_df

import __spark_entry__ as E
from spoframe.operators import Var, predicate_catalogue, predicate_stats
from spoframe.operators.cycles import triangle_join, triangle_routes
from spoframe.plans import TripleStore, load_store, load_tables, load_text, match, match_all, shared_scans
from spoframe.session import Scratch
from spoframe.sources import triples_from_tables, write_triples


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return load_store(triples_from_tables(spark, SF_SMALL), os.path.join(str(tmp_path_factory.mktemp("store")), "s"))


def test_unselected_variables_only_have_to_exist(store):
    want = rows_of(match(store, E.EXISTS_ONLY).select("o").distinct())
    for layout in ("vp", "mixed"):
        df = match(store, E.EXISTS_ONLY, ["o"], layout=layout)
        plan = optimized(df)
        assert "Generate" not in plan and "Join Inner" not in plan, plan
        assert rows_of(df) == want
    # in the star they are NOT NULL tests of one scan, without any join
    assert "Join" not in optimized(match(store, E.EXISTS_ONLY, ["o"], layout="mixed"))
    # a chain's end and its middle are semi-joins
    assert "Join Inner" not in optimized(match(store, E.CHAIN, ["o"]))


def test_variables_that_differ_by_case_or_hold_dots(spark):
    t = triples_df(spark, [("a", "p", "b"), ("b", "p", "c"), ("a", "a.b", "1"), ("b", "`q", "2"), ("b", "__c0", "3")])
    mem = TripleStore.from_triples(t, with_property_table=True)
    for layout in ("vp", "mixed"):
        got = match(mem, [(Var("x"), "p", Var("X")), (Var("X"), "p", Var("y.z"))], layout=layout, min_group_size=1)
        assert got.columns == ["x", "X", "y.z"] and [tuple(r) for r in got.collect()] == [("a", "b", "c")]
        got = match(mem, [(Var("x"), "p", Var("X")), (Var("x"), "a.b", Var("v")), (Var("X"), "`q", "2"), (Var("X"), "__c0", Var("s"))], layout=layout)
        assert [tuple(r) for r in got.collect()] == [("a", "b", "1", "3")]


def edges_of(seed: int, n: int = 400):
    """Three random edge sets between three sides, a third of all edges on one value of b."""
    rng = random.Random(seed)
    node = lambda side: f"{side}{rng.randrange(40)}"
    ab = [(node("a"), "b0" if rng.random() < 0.33 else node("b")) for _ in range(n)]
    bc = [("b0" if rng.random() < 0.33 else node("b"), node("c")) for _ in range(n)]
    ca = [(node("c"), node("a")) for _ in range(3 * n)]
    return ab, bc, ca


@pytest.mark.parametrize("seed", [1, 2])
def test_triangles_match_brute_force_and_stay_small(spark, seed):
    ab, bc, ca = edges_of(seed)
    frames = [spark.createDataFrame(e, f"{n[0]} string, {n[1]} string") for e, n in ((ab, "ab"), (bc, "bc"), (ca, "ca"))]
    want = {(a, b, c) for a, b in ab for b2, c in bc if b == b2 for c2, a2 in ca if (c, a) == (c2, a2)}
    got = {(r.a, r.b, r.c) for r in triangle_join(*frames).collect()}
    assert got == want and want
    rows = triangle_routes(*frames).collect()
    routes = {r.b: r.route for r in rows}
    assert routes["b0"] != "b" and "b" in routes.values()
    through = {r.b: {"b": r.through_b, "a": r.through_a, "c": r.through_c} for r in rows}
    made = sum(costs[routes[b]] for b, costs in through.items())
    # the usual join makes the product of b0's degrees; this stays within 4 times input and output
    assert made <= 4 * (len(ab) + len(bc) + len(ca) + len(want)) < sum(c["b"] for c in through.values())
    t = triples_df(spark, [(a, "r", b) for a, b in ab] + [(b, "s", c) for b, c in bc] + [(c, "t", a) for c, a in ca])
    a, b, c = Var("a"), Var("b"), Var("c")
    mem = TripleStore.from_triples(t, with_stats=True)
    for cycles in ("split", "plain"):
        found = match(mem, [(a, "r", b), (b, "s", c), (c, "t", a)], cycles=cycles)
        assert {tuple(r) for r in found.select("a", "b", "c").collect()} == want
    # as a part of a larger query, and reduced
    more = t.unionByName(triples_df(spark, [(f"c{i}", "name", str(i % 3)) for i in range(40)]))
    mem = TripleStore.from_triples(more, with_stats=True)
    pats = [(a, "r", b), (b, "s", c), (c, "t", a), (c, "name", "1")]
    for reduce in (False, True):
        found = match(mem, pats, ["a", "c"], reduce=reduce)
        assert {tuple(r) for r in found.collect()} == {(x, z) for x, _, z in want if int(z[1:]) % 3 == 1}


def test_triangle_sides_share_one_variable(spark):
    ab = spark.createDataFrame([], "a string, b string")
    with pytest.raises(ValueError):
        triangle_join(ab, ab, ab)


def test_subject_joins_of_named_tables_need_no_shuffle(spark):
    database = f"spoframe_test_{uuid.uuid4().hex}"
    load_tables(triples_from_tables(spark, SF_SMALL), database, buckets=4)
    named = TripleStore.open_database(spark, database)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pats = [(E.o, E.P("status"), E.st), (E.o, E.P("placedBy"), E.c), (E.o, E.P("hasPart"), E.p)]
        df = match(named, pats)
        plan = plan_of(df)
        # DISTINCT over columns that include the subject: the buckets hold them together, too
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2, plan
        mixed = match(named, [(E.p, E.P("brand"), "Brand#7"), (E.p, E.P("type"), E.t)], layout="mixed")
        assert "Exchange" not in plan_of(mixed)
        plain = match(TripleStore.from_triples(triples_from_tables(spark, SF_SMALL)), pats)
        assert rows_of(df) == rows_of(plain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP DATABASE {database} CASCADE")


def test_batches_scan_a_shared_filter_once(spark, store):
    with Scratch(spark) as scratch:
        shared = shared_scans(store, E.SHARED_BATCH, scratch)
        assert {(k[0], k[2]) for k in shared} == {(E.P("segment"), "BUILDING"), (E.P("status"), "F")}
        assert scratch.tables == 2
        results = match_all(store, E.SHARED_BATCH, scratch)
        for name, (pats, select) in E.SHARED_BATCH.items():
            vp_scans = len(re.findall(r"PartitionFilters: \[[^\]]", plan_of(results[name])))
            filtered = sum(any(not isinstance(t, Var) for t in (p[0], p[2])) for p in pats)
            assert vp_scans == len(pats) - filtered, name  # the shared ones are read from the scratch folder
            assert rows_of(results[name]) == rows_of(match(store, pats, select))
        where = scratch.path
    assert not os.path.exists(where.removeprefix("file:"))


def test_profile_takes_one_scan_and_two_exchanges(spark):
    rows = triples_df(spark, [("s", "p", "a"), ("s", "p", "b"), ("t", "q", "a")]).repartition(2)
    base = plan_of(rows).count("Exchange ")
    for df in (predicate_catalogue(rows), predicate_stats(rows)):
        assert plan_of(df).count("Exchange ") - base == 2
    tables = triples_from_tables(spark, SF_SMALL)
    assert plan_of(predicate_catalogue(tables)).count("FileScan") == 8  # each mapped table once


def test_a_subject_opens_one_file(spark, tmp_out):
    triples = triples_from_tables(spark, SF_SMALL)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so small a table is one file
    try:
        big = load_store(triples, os.path.join(tmp_out, "s"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert big.files.count() > 1
    df = match(big, E.CONST_SUBJECT, layout="mixed")
    one = big.properties_of("order/100")
    assert len(one.inputFiles()) == 1 and one.where("s = 'order/100'").count() == 1
    assert rows_of(df) == rows_of(match(big, E.CONST_SUBJECT))
    assert big.properties_of("").count() == 0  # before all subjects


def test_reduction_writes_each_node_once(spark, store):
    with Scratch(spark) as scratch:
        df = match(store, E.SNOWFLAKE, ["o", "n", "st"], reduce=True, scratch=scratch)
        assert 0 < scratch.tables <= 4  # of five patterns the leaves stay lazy
        assert rows_of(df) == rows_of(match(store, E.SNOWFLAKE, ["o", "n", "st"]))


def test_rejected_lines_are_counted_by_the_load(spark, tmp_out):
    path = os.path.join(tmp_out, "text")
    write_triples(triples_df(spark, [("a", "p", "1"), ("b", "p", "")]), path)
    extra = spark.createDataFrame([("one field",), ("two\tfields",), ("",), ("c\tp\t2\tmore",)], "value string")
    extra.write.mode("append").text(path)
    loaded = load_text(spark, path, os.path.join(tmp_out, "store"))
    assert {k: loaded.manifest[k] for k in ("triples", "null_rows", "rejected_lines")} == {"triples": 3, "null_rows": 0, "rejected_lines": 3}
    assert rows_of(match(loaded, [(Var("s"), "p", Var("o"))])) == [("a", "1"), ("b", ""), ("c", "2")]
