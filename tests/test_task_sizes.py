"""The rows of a task do not grow with the input: widths by the number of triples, the same rows at any width."""

import os

import pytest
from conftest import rows_of, triples_df

from spoframe.operators import graph_stats, list_chunks, plan_columns, predicate_stats, properties_array, property_table
from spoframe.plans import TripleStore, load_store, load_tables
from spoframe.session import TASK_ROWS, load_session, task_count
from spoframe.sources import read_property_table, write_property_table

ROWS = [(f"s{i % 40}", p, f"o{i % k}") for i in range(200) for p, k in (("a", 7), ("b", 200))]
ROWS += [(f"s{i}", "one", str(i)) for i in range(40)] + [("hub", "a", f"o{i}") for i in range(500)]


@pytest.fixture(scope="module")
def triples(spark):
    return triples_df(spark, ROWS).cache()


def test_tasks_go_by_rows(spark):
    assert task_count(0) == task_count(10) == 1
    assert [task_count(n * TASK_ROWS) for n in (100, 1000)] == [100, 1000]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    own = load_session(spark, 500 * TASK_ROWS)
    assert own.conf.get("spark.sql.shuffle.partitions") == "500" and spark.conf.get("spark.sql.shuffle.partitions") == before
    assert own.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")


def test_statistics_are_the_same_at_any_width(triples):
    stats = predicate_stats(triples)
    assert rows_of(predicate_stats(triples, 5)) == rows_of(stats)
    assert rows_of(graph_stats(triples, stats, 5)) == rows_of(graph_stats(triples, stats))


def test_tables_have_the_width_asked_for(triples):
    cols = plan_columns(predicate_stats(triples))
    sort = lambda rows: sorted((r[0], *[sorted(x) if isinstance(x, list) else x for x in r[1:]]) for r in map(tuple, rows))
    want = sort(property_table(triples, cols).collect())
    for ranged in (False, True):
        got = property_table(triples, cols, 5, ranged)
        assert got.rdd.getNumPartitions() == 5 and sort(got.collect()) == want
    lists = {r["s"]: [x and sorted(x) for x in r["props"]] for r in properties_array(triples, ["a", "one"]).collect()}
    got = properties_array(triples, ["a", "one"], 5)
    assert got.rdd.getNumPartitions() == 5
    assert {r["s"]: [x and sorted(x) for x in r["props"]] for r in got.collect()} == lists
    for short in ((), ("a", "b", "one")):
        got = list_chunks(triples, ["a", "b", "one"], 1000, short, tasks=5)
        assert got.rdd.getNumPartitions() == 5 and rows_of(got) == rows_of(list_chunks(triples, ["a", "b", "one"]))


def test_a_table_built_by_range_is_written_as_it_lies(spark, triples, tmp_out):
    table = property_table(triples, plan_columns(predicate_stats(triples)), 5, ranged=True)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning" in plan
    path = os.path.join(tmp_out, "pt")
    write_property_table(table, path, ranged=True)
    spans = [(f["first"], f["last"]) for f in load_files(spark, path)]
    assert len(spans) == 5 and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    assert read_property_table(spark, path).count() == 41


def load_files(spark, path):
    from spoframe.sources.layouts import subject_files

    return subject_files(read_property_table(spark, path)).orderBy("first").collect()


def test_a_load_leaves_the_session_and_cuts_row_groups(spark, triples, tmp_out):
    before = {k: v for k, v in spark.conf.getAll.items()}
    store = load_store(triples, os.path.join(tmp_out, "store"))
    assert dict(spark.conf.getAll.items()) == before
    assert store.vp.sparkSession.conf.get("spark.sql.files.maxPartitionBytes") == before.get(
        "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    assert store.vp.count() == len(ROWS)


def test_buckets_go_by_rows_unless_given(spark, triples, monkeypatch):
    import spoframe.plans.store as module

    monkeypatch.setattr(module, "task_count", lambda rows: 9 if rows == len(ROWS) else 1)
    name = f"task_sizes_{os.getpid()}"
    try:
        load_tables(triples, name)
        described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}.triples").collect()}
        assert described["Num Buckets"] == "9"
        assert TripleStore.open_database(spark, name).vp.count() == len(ROWS)
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
