import os

from conftest import rows_of, triples_df

from spoframe.operators import Var, plan_columns, predicate_stats, properties_array, property_table
from spoframe.plans import TripleStore, load_store, match
from spoframe.sources import read_property_table, write_property_table

WORKED = [("s1", "likes", "o1"), ("s1", "likes", "o2"), ("s1", "has", "o3"), ("s1", "contains", "o4")]


def test_worked_aggregate_example(spark):
    t = triples_df(spark, WORKED)
    row = properties_array(t, ["likes", "has", "contains", "is"]).collect()[0]
    props = [sorted(x) if x is not None else None for x in row["props"]]
    assert row["s"] == "s1"
    assert props == [["o1", "o2"], ["o3"], ["o4"], None]


def test_types_by_multiplicity_and_null_for_absent(spark):
    t = triples_df(spark, WORKED + [("s2", "has", "o5")])
    cols = plan_columns(predicate_stats(t))
    pt = property_table(t, cols)
    types = {f.name: f.dataType.simpleString() for f in pt.schema.fields}
    assert types == {"s": "string", "contains": "string", "has": "string", "likes": "array<string>"}
    rows = {r["s"]: r.asDict() for r in pt.collect()}
    assert sorted(rows["s1"]["likes"]) == ["o1", "o2"]
    assert rows["s2"]["likes"] is None and rows["s2"]["contains"] is None
    assert rows["s2"]["has"] == "o5"


def test_exact_duplicate_kept_in_list_and_distinct_in_query(spark):
    t = triples_df(spark, [("s", "p", "a"), ("s", "p", "a")])
    store = TripleStore.from_triples(t, with_property_table=True)
    assert store.property_table.collect()[0]["p"] == ["a", "a"]
    x = Var("x")
    assert match(store, [(Var("s"), "p", x)], layout="mixed", min_group_size=1).count() == 1
    assert match(store, [(Var("s"), "p", x)]).count() == 1


def test_awkward_objects_survive_both_layouts(spark, tmp_out):
    objs = ["a$%b", "", "it's", '"quoted"']
    t = triples_df(spark, [("s", "p", v) for v in objs] + [("s", "q", "z")])
    store = load_store(t, os.path.join(tmp_out, "store"))
    x = Var("x")
    pats = [(Var("s"), "p", x), (Var("s"), "q", "z")]
    assert sorted(r["x"] for r in match(store, pats).collect()) == sorted(objs)
    assert sorted(r["x"] for r in match(store, pats, layout="mixed").collect()) == sorted(objs)
    for v in objs:
        assert match(store, [(Var("s"), "p", v), (Var("s"), "q", "z")], layout="mixed").count() == 1


def test_property_table_round_trip(spark, tmp_out):
    t = triples_df(spark, WORKED)
    pt = property_table(t, plan_columns(predicate_stats(t)))
    path = os.path.join(tmp_out, "pt")
    write_property_table(pt, path)
    assert rows_of(read_property_table(spark, path), "s", "has") == [("s1", "o3")]


def test_lists_of_any_length_stay_whole(spark):
    s, x, y = Var("s"), Var("x"), Var("y")
    for k in (1_000, 1_001, 100_000):
        hub = spark.range(k).selectExpr("'hub' AS s", "'p' AS p", "concat('o', id) AS o")
        t = hub.unionByName(triples_df(spark, [("hub", "q", "a"), ("only", "p", "o1"), ("t", "q", "b")]))
        store = TripleStore.from_triples(t, with_property_table=True)
        assert sorted(store.property_table.columns) == ["p", "q", "s"]
        assert rows_of(store.property_table, "s") == [("hub",), ("only",), ("t",)]
        got = match(store, [(s, "p", x), (s, "q", y)], layout="mixed")
        assert got.count() == k


def test_rows_with_null_parts_are_not_triples(spark, tmp_out):
    t = triples_df(spark, [("s", "p", "a"), ("s", "p", None), (None, "p", "b"), ("s", None, "c"), ("t", "q", None)])
    x = Var("x")
    for store in (TripleStore.from_triples(t, with_property_table=True), load_store(t, os.path.join(tmp_out, "st"))):
        assert rows_of(match(store, [(Var("s"), "p", x)])) == [("s", "a")]
        assert rows_of(match(store, [(Var("s"), "p", x)], layout="mixed", min_group_size=1)) == [("s", "a")]
        assert set(store.pt_columns) == {"p"}
        assert store.property_table.collect()[0]["p"] == "a"


def test_properties_array_is_whole(spark):
    rows = [("hub", "p", f"o{i}") for i in range(3000)] + [("t", "q", "a")]
    got = {r["s"]: r["props"] for r in properties_array(triples_df(spark, rows), ["p", "q"]).collect()}
    assert len(got["hub"][0]) == 3000 and got["hub"][1] is None and got["t"] == [None, ["a"]]
