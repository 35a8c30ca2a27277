"""The user flow: text triples -> stored layouts -> queries -> sinks."""

import os

from conftest import rows_of

from spoframe import Var, load_store, match
from spoframe.plans import TripleStore, match_all, tagged_union, write_all
from spoframe.sources import read_result, read_triples, write_result_table

LINES = [
    "alice\tknows\tbob",
    "alice\tknows\tcarol",
    "bob\tknows\tcarol",
    "carol\tknows\talice",
    "alice\tage\t30",
    "bob\tage\t25",
    "carol\tage\t35",
    "bob\tworksAt\tacme",
    "carol\tworksAt\tacme",
    "broken line",
]


def test_text_to_store_to_results(spark, tmp_out):
    src = os.path.join(tmp_out, "triples.tsv")
    with open(src, "w") as f:
        f.write("\n".join(LINES) + "\n")
    text = read_triples(spark, src)
    assert text.rejected.count() == 1
    store = load_store(text.triples, os.path.join(tmp_out, "store"))
    assert store.property_table is not None and store.stats is not None
    reopened = TripleStore.open(spark, os.path.join(tmp_out, "store"))
    assert set(reopened.pt_columns) == {"knows", "age", "worksAt"}

    x, y, z, a = Var("x"), Var("y"), Var("z"), Var("a")
    triangle = [(x, "knows", y), (y, "knows", z), (z, "knows", x)]
    expected = [("alice", "bob", "carol"), ("bob", "carol", "alice"), ("carol", "alice", "bob")]
    for layout in ("vp", "mixed"):
        for reduce in (False, True, "auto"):
            assert rows_of(match(reopened, triangle, layout=layout, reduce=reduce)) == expected
    colleagues = [(x, "worksAt", "acme"), (x, "age", a)]
    assert rows_of(match(reopened, colleagues, layout="mixed")) == [("bob", "25"), ("carol", "35")]

    results = match_all(reopened, {"triangle": (triangle, ["x"]), "colleagues": (colleagues, ["x", "a"])})
    paths = write_all(results, os.path.join(tmp_out, "results"))
    assert rows_of(read_result(spark, paths["colleagues"])) == [("bob", "25"), ("carol", "35")]
    union = tagged_union(results)
    assert sorted(union.columns) == ["a", "query", "x"] and union.count() == 5

    name = write_result_table(results["triangle"], "triangle", database="spo_test")
    assert rows_of(spark.table(name)) == [("alice",), ("bob",), ("carol",)]
