"""Queries over the test tables: known counts (sf0.001) and metamorphic checks."""

import itertools
import os

import pytest
from conftest import SF_SMALL, rows_of

import __spark_entry__ as E
from spoframe.plans import TripleStore, load_store, match
from spoframe.sources import triples_from_tables

EXPECTED = {
    "join_chain": 342,
    "join_snowflake": 277,
    "bgp_mixed": 11,
    "bgp_cycle": 194,
    "star_explode": 1980,
    "star_two_explodes": 4756,
    "star_const_single": 5,
    "star_array_contains": 500,
    "pattern_const_subject": 3,
    "semijoin_up": 342,
    "semijoin_down": 145,
}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("store"))
    return load_store(triples_from_tables(spark, SF_SMALL), os.path.join(base, "s"))


def test_triple_counts(spark):
    t = triples_from_tables(spark, SF_SMALL)
    assert t.count() == 20325
    assert t.distinct().count() == 18293


@pytest.mark.parametrize("name,count", sorted(EXPECTED.items()))
def test_known_counts(spark, name, count):
    assert E.queries()[name](spark, SF_SMALL).count() == count


def test_store_shape(store):
    assert store.property_table.count() == 1905
    lists = {c.p.rsplit("/", 1)[-1] for c in store.pt_columns.values() if c.is_list}
    assert lists == {"did>", "hasPart>", "hasSupplier>"}


@pytest.mark.parametrize("pats,select", [(E.MIXED, None), (E.CYCLE, None), (E.SNOWFLAKE, ["o", "n", "st"])])
def test_layouts_reduction_and_stats_agree(store, pats, select):
    base = rows_of(match(store, pats, select, use_stats=False))
    for layout, reduce, use_stats in itertools.product(["vp", "mixed"], [False, True, "auto"], [False, True]):
        got = match(store, pats, select, layout=layout, reduce=reduce, use_stats=use_stats)
        assert rows_of(got) == base, (layout, reduce, use_stats)


def test_pattern_order_does_not_matter(store):
    base = rows_of(match(store, E.CYCLE, ["o", "c", "s", "n"]))
    for perm in list(itertools.permutations(E.CYCLE))[::5]:
        assert rows_of(match(store, list(perm), ["o", "c", "s", "n"], use_stats=False)) == base


def test_group_sizes_agree(store):
    base = rows_of(match(store, E.MIXED, layout="vp"))
    for k in (1, 2, 3, 4):
        assert rows_of(match(store, E.MIXED, layout="mixed", min_group_size=k)) == base


def test_materialized_reduction_agrees(store):
    base = rows_of(match(store, E.MIXED, layout="mixed"))
    assert rows_of(match(store, E.MIXED, layout="mixed", reduce=True, materialize=True)) == base


def test_in_memory_store_agrees_with_written(spark, store):
    mem = TripleStore.from_triples(triples_from_tables(spark, SF_SMALL), with_property_table=True)
    assert rows_of(match(mem, E.MIXED, layout="mixed")) == rows_of(match(store, E.MIXED, layout="mixed"))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["o", "c", "p", "t"]
    assert df.count() == 11


def test_fixture_statistics(store):
    from spoframe.sources import predicate as P

    stats = {r["p"]: (r["size"], r["distinct_subjects"]) for r in store.stats.collect()}
    assert len(stats) == 14
    assert stats[P("hasPart")] == (6000, 1473)
    assert stats[P("did")] == (1000, 15)
    assert stats[P("name")] == (390, 390)


def test_orders_without_parts_have_null_cells(store):
    from pyspark.sql import functions as F

    from spoframe.sources import predicate as P

    pt = store.property_table
    has_part = store.pt_columns[P("hasPart")].column
    placed_by = store.pt_columns[P("placedBy")].column
    orders = pt.where(F.col(placed_by).isNotNull())
    assert orders.where(F.col(has_part).isNull()).count() == 27


def test_fixture_graph_statistics(store):
    from spoframe.operators import graph_stats

    row = graph_stats(store.vp, store.stats).collect()[0]
    assert (row["size"], row["distinct_subjects"], row["predicates"]) == (20325, 1905, 14)
