import math

from conftest import rows_of, triples_df

from spoframe.operators import (
    distinct_predicates,
    lookup_stats,
    multivalued_predicates,
    predicate_catalogue,
    predicate_profile,
    predicate_stats,
    single_valued_predicates,
)

WORKED = [("s1", "likes", "o1"), ("s1", "likes", "o2"), ("s1", "has", "o3"), ("s1", "contains", "o4")]


def test_distinct_and_multivalued(spark):
    t = triples_df(spark, WORKED + [("s2", "has", "o3")])
    assert rows_of(distinct_predicates(t)) == [("contains",), ("has",), ("likes",)]
    assert rows_of(multivalued_predicates(t)) == [("likes",)]
    assert rows_of(single_valued_predicates(t)) == [("contains",), ("has",)]
    assert rows_of(predicate_catalogue(t)) == [("contains", 0), ("has", 0), ("likes", 1)]


def test_exact_duplicate_is_multivalued(spark):
    t = triples_df(spark, [("s", "p", "a"), ("s", "p", "a")])
    assert rows_of(multivalued_predicates(t)) == [("p",)]
    row = predicate_stats(t).collect()[0]
    assert (row["size"], row["distinct_subjects"], row["distinct_objects"], row["max_multiplicity"]) == (2, 1, 1, 2)
    assert row["is_complex"] is True


def test_stats_and_profile(spark):
    t = triples_df(spark, WORKED + [("s2", "likes", "o1"), ("s3", "likes", "o9")])
    stats = {r["p"]: r.asDict() for r in predicate_stats(t).collect()}
    assert stats["likes"]["size"] == 4
    assert stats["likes"]["distinct_subjects"] == 3
    assert stats["likes"]["distinct_objects"] == 3
    assert stats["likes"]["max_multiplicity"] == 2
    prof = {r["p"]: r.asDict() for r in predicate_profile(predicate_stats(t)).collect()}
    assert prof["likes"]["avg_multiplicity"] == round(4 / 3, 4)
    assert prof["likes"]["cost"] == round(4 * math.log(3) / math.log(1.2), 4)
    assert prof["has"]["cost"] == 0.0


def test_lookup_unknown_is_minus_one(spark):
    t = triples_df(spark, WORKED)
    wanted = spark.createDataFrame([("likes",), ("nope",)], "p string")
    got = {r["p"]: (r["size"], r["distinct_subjects"]) for r in lookup_stats(predicate_stats(t), wanted).collect()}
    assert got == {"likes": (2, 1), "nope": (-1, -1)}


def test_graph_stats(spark):
    from spoframe.operators import graph_stats

    t = triples_df(spark, WORKED + [("s2", "has", "o3"), ("s2", "has", "o3")])
    expected = [(6, 2, 3)]
    assert rows_of(graph_stats(t), "size", "distinct_subjects", "predicates") == expected
    got = graph_stats(t, predicate_stats(t))
    assert rows_of(got, "size", "distinct_subjects", "predicates") == expected
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
