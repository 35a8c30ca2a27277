import pytest
from conftest import rows_of, triples_df

from spoframe.operators import Var, natural_join, scan_pattern, semijoin
from spoframe.plans import TripleStore, match

x, y, s, z = Var("x"), Var("y"), Var("s"), Var("z")


def store_of(spark, rows, **kw):
    return TripleStore.from_triples(triples_df(spark, rows), with_property_table=True, **kw)


@pytest.mark.parametrize("layout", ["vp", "mixed"])
def test_repeated_variable(spark, layout):
    st = store_of(spark, [("a", "p", "a"), ("a", "p", "b")])
    assert rows_of(match(st, [(x, "p", x)], layout=layout, min_group_size=1)) == [("a",)]


@pytest.mark.parametrize("layout", ["vp", "mixed"])
def test_two_shared_variables(spark, layout):
    st = store_of(spark, [("a", "p", "b"), ("a", "q", "b"), ("a", "q", "c")])
    assert rows_of(match(st, [(x, "p", y), (x, "q", y)], layout=layout)) == [("a", "b")]


@pytest.mark.parametrize("layout", ["vp", "mixed"])
def test_same_predicate_twice(spark, layout):
    st = store_of(spark, [("s", "p", "a"), ("s", "p", "b")])
    assert match(st, [(s, "p", x), (s, "p", y)], layout=layout).count() == 4


@pytest.mark.parametrize("layout", ["vp", "mixed"])
def test_same_object_variable_in_star(spark, layout):
    st = store_of(spark, [("s", "p", "a"), ("s", "q", "a"), ("t", "p", "a"), ("t", "q", "b")])
    assert rows_of(match(st, [(x, "p", y), (x, "q", y)], layout=layout)) == [("s", "a")]


@pytest.mark.parametrize("layout", ["vp", "mixed"])
def test_constant_subject_star(spark, layout):
    st = store_of(spark, [("s", "p", "a"), ("s", "q", "b"), ("t", "p", "c"), ("t", "q", "d")])
    assert rows_of(match(st, [("s", "p", x), ("s", "q", y)], layout=layout)) == [("a", "b")]


def test_constant_subject_filters_subject_not_object(spark):
    st = store_of(spark, [("k", "p", "v"), ("v", "p", "k")])
    assert rows_of(match(st, [("k", "p", y)])) == [("v",)]


def test_disconnected_raises_before_any_job(spark):
    st = store_of(spark, [("a", "p", "b"), ("c", "q", "d")])
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    with pytest.raises(ValueError):
        match(st, [(Var("a"), "p", Var("b")), (Var("c"), "q", Var("d"))])
    assert len(tracker.getJobIdsForGroup()) == before


def test_unknown_predicate_is_empty_with_columns(spark):
    st = store_of(spark, [("a", "p", "b")])
    got = match(st, [(x, "nope", y)])
    assert got.columns == ["x", "y"] and got.count() == 0
    got = match(st, [(x, "nope", y), (x, "p", z)], layout="mixed", min_group_size=1)
    assert sorted(got.columns) == ["x", "y", "z"] and got.count() == 0


def test_both_constants(spark):
    st = store_of(spark, [("s", "p", "a"), ("s", "q", "b")])
    assert match(st, [("s", "p", "zzz"), (x, "q", y)]).count() == 0
    assert rows_of(match(st, [("s", "p", "a"), (x, "q", y)])) == [("s", "b")]
    only = match(st, [("s", "p", "a")])
    assert only.columns == [] and only.count() == 1
    assert match(st, [("s", "p", "zzz")]).count() == 0


def test_variable_and_constant_with_same_text_are_not_shared(spark):
    st = store_of(spark, [("x", "p", "1"), ("y", "p", "2"), ("y", "q", "x")])
    got = match(st, [(x, "p", "2"), (x, "q", "x")])
    assert rows_of(got) == [("y",)]


def test_select_unknown_variable_rejected(spark):
    st = store_of(spark, [("a", "p", "b")])
    with pytest.raises(ValueError):
        match(st, [(x, "p", y)], ["nope"])


def test_join_and_semijoin_primitives(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "k string, v string")
    b = spark.createDataFrame([("1", "x"), ("1", "z")], "k string, v string")
    assert rows_of(natural_join(a, b)) == [("1", "x")]
    assert rows_of(semijoin(a, b.select("k"))) == [("1", "x")]
    with pytest.raises(ValueError):
        natural_join(a, b.select("v").withColumnRenamed("v", "w"))


def test_scan_pattern_keeps_rows(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", "b")], "s string, o string")
    assert scan_pattern(rows, (x, "p", y)).count() == 2


def test_order_avoids_low_cardinality_join_and_prefers_selective_constant():
    from spoframe.plans.match import Unit, _scores, order_units
    from spoframe.operators import Pattern

    o, c, n, s_ = Var("o"), Var("c"), Var("n"), Var("s")
    cycle = [Pattern(o, "placedBy", c), Pattern(c, "inNation", n), Pattern(o, "hasSupplier", s_), Pattern(s_, "inNation", n)]
    units = [Unit([p], False) for p in cycle]
    stats = {"placedBy": (150_000, 150_000, 10_000), "inNation": (16_000, 16_000, 25), "hasSupplier": (600_000, 150_000, 1_000)}
    order = order_units(units, _scores(units, stats), stats)
    assert order == [1, 0, 2, 3]  # never inNation-inNation on ?n as the second step
    # among constant patterns the one matching fewer rows goes first
    pats = [Pattern(x, "type", "Person"), Pattern(x, "name", "Ada")]
    units = [Unit([p], False) for p in pats]
    stats = {"type": (3_000_000, 3_000_000, 3), "name": (3_000_000, 3_000_000, 2_900_000)}
    assert order_units(units, _scores(units, stats), stats)[0] == 1
    assert order_units(units, _scores(units, None), None) == [0, 1]
