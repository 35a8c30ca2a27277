"""A third of all rows on one key: results stay whole and all layouts agree."""

import os

from conftest import rows_of

from spoframe.operators import Var, predicate_stats
from spoframe.plans import load_store, match


def test_hot_subject_and_duplicate_block(spark, tmp_out):
    n_cold = 2000
    cold = spark.range(n_cold).selectExpr(
        "concat('item/', id) AS s", "'<hasTag>' AS p", "concat('tag/', id % 50) AS o"
    )
    names = spark.range(n_cold).selectExpr("concat('item/', id) AS s", "'<name>' AS p", "concat('n', id) AS o")
    tag_names = spark.range(50).selectExpr("concat('tag/', id) AS s", "'<name>' AS p", "concat('t', id) AS o")
    # one subject holds a third of all rows under one predicate, as 1,500 distinct objects
    # each copied twice (a block of exact duplicates)
    hot = spark.range(3000).selectExpr("'item/0' AS s", "'<hasTag>' AS p", "concat('tag/', id % 1500) AS o")
    triples = cold.unionByName(names).unionByName(tag_names).unionByName(hot)
    total = triples.count()
    assert 3000 / total > 0.3

    stats = {r["p"]: r for r in predicate_stats(triples).collect()}
    assert stats["<hasTag>"]["size"] == n_cold + 3000
    assert stats["<hasTag>"]["max_multiplicity"] == 3001
    assert stats["<hasTag>"]["distinct_objects"] == 1500

    store = load_store(triples, os.path.join(tmp_out, "store"))
    assert "<hasTag>" in store.pt_columns and "<name>" in store.pt_columns
    assert store.manifest["triples"] == total and store.manifest["null_rows"] == 0

    x, t, nm = Var("x"), Var("t"), Var("nm")
    pats = [(x, "<hasTag>", t), (t, "<name>", nm), (x, "<name>", Var("xn"))]
    base = rows_of(match(store, pats, ["x", "nm"], use_stats=False))
    # item/0 reaches tags tag/0..tag/49 only (those have names); cold items one tag each
    assert len(base) == n_cold - 1 + 50
    for layout in ("vp", "mixed"):
        for reduce in (False, True):
            assert rows_of(match(store, pats, ["x", "nm"], layout=layout, reduce=reduce)) == base
    # the hot subject's rows are all there (duplicates collapse in DISTINCT only)
    assert match(store, [("item/0", "<hasTag>", t)]).count() == 1500


def test_hot_predicate_is_split_into_several_files(spark, tmp_out):
    from pyspark.sql import functions as F

    from spoframe.sources import predicate_id, read_vp, scan_vp, write_vp

    hot = spark.range(200_000).selectExpr("concat('s', id) AS s", "'<hot>' AS p", "concat('o', id) AS o")
    cold = spark.range(100).selectExpr("concat('c', id) AS s", "concat('<cold', id % 10, '>') AS p", "'x' AS o")
    path = os.path.join(tmp_out, "vp")
    conf = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "256k")
    try:
        write_vp(hot.unionByName(cold).repartition(8), path)
    finally:
        spark.conf.set(conf, before)
    pid = spark.range(1).select(predicate_id(F.lit("<hot>"))).first()[0]
    files = [f for f in os.listdir(os.path.join(path, f"pid={pid}")) if f.endswith(".parquet")]
    assert len(files) > 1, files  # AQE cut the hot predicate into several files
    cold_dirs = [d for d in os.listdir(path) if d.startswith("pid=") and d != f"pid={pid}"]
    assert len(cold_dirs) == 10
    vp = read_vp(spark, path)
    assert scan_vp(vp, "<hot>").count() == 200_000
    # files are sorted by subject: a constant-subject lookup is a pushed filter
    plan = scan_vp(vp, "<hot>").where("s = 's42'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(s,s42)" in plan
