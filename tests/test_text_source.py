import os
import re

import pytest
from conftest import rows_of, triples_df

from spoframe.sources import read_triples, write_triples


def test_text_source_fields_and_rejects(spark, tmp_out):
    path = os.path.join(tmp_out, "in.tsv")
    with open(path, "w") as f:
        f.write("a\tp\tb\t.\na\tp\nc\tp\t\n\n")
    got = read_triples(spark, path)
    assert rows_of(got.triples) == [("a", "p", "b"), ("c", "p", "")]
    assert got.rejected.count() == 2


def test_text_round_trip_keeps_awkward_values(spark, tmp_out):
    rows = [("s", "p", "a$%b"), ("s", "p", ""), ("s", "p", "it's"), ("s", "p", '"quoted"')]
    path = os.path.join(tmp_out, "out")
    write_triples(triples_df(spark, rows), path)
    assert rows_of(read_triples(spark, path).triples) == sorted(rows)


def test_writer_refuses_tab_in_value(spark, tmp_out):
    with pytest.raises(Exception):
        write_triples(triples_df(spark, [("s", "p", "a\tb")]), os.path.join(tmp_out, "bad"))


def test_partitioned_layout_keeps_any_predicate_text(spark, tmp_out):
    from spoframe.sources import read_vp, scan_vp, write_vp

    preds = ["123", "a/b=c%d", "x y", "", "<http://x/é>", "null", "__HIVE_DEFAULT_PARTITION__", "<" + "p" * 400 + ">"]
    rows = [("s", p, f"o{i}") for i, p in enumerate(preds)]
    path = os.path.join(tmp_out, "vp")
    write_vp(triples_df(spark, rows), path)
    vp = read_vp(spark, path)
    assert rows_of(vp, "s", "p", "o") == sorted(rows)
    for i, p in enumerate(preds):
        assert [r["o"] for r in scan_vp(vp, p).collect()] == [f"o{i}"]


def test_predicate_scan_is_partition_pruned(spark, tmp_out):
    from pyspark.sql import functions as F

    from spoframe.sources import predicate_id, read_vp, scan_vp, write_vp

    path = os.path.join(tmp_out, "vp")
    write_vp(triples_df(spark, [("s", "p", "o"), ("s", "q", "o")]), path)
    plan = scan_vp(read_vp(spark, path), "p")._jdf.queryExecution().executedPlan().toString()
    pid = spark.range(1).select(predicate_id(F.lit("p"))).first()[0]
    found = re.search(r"PartitionFilters: \[isnotnull\(pid#\d+L?\), \(pid#\d+L? = (-?\d+)\)\]", plan)
    assert found and int(found.group(1)) == pid, plan
    assert "EqualTo(p,p)" in plan


def test_partitioned_write_without_adaptive_execution(spark, tmp_out):
    from spoframe.sources import read_vp, scan_vp, write_vp

    rows = [("s%d" % i, "hot", "o%d" % i) for i in range(200)] + [("a", "cold", "b")]
    path = os.path.join(tmp_out, "vp")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_vp(triples_df(spark, rows), path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    vp = read_vp(spark, path)
    assert scan_vp(vp, "hot").count() == 200
    assert rows_of(scan_vp(vp, "cold")) == [("a", "b")]


def test_partitioned_layout_refuses_to_overwrite(spark, tmp_out):
    from spoframe.sources import read_vp, write_vp

    path = os.path.join(tmp_out, "vp")
    t = triples_df(spark, [("s", "p", "o")])
    write_vp(t, path)
    with pytest.raises(Exception):
        write_vp(t, path)  # A4: fail if the layout exists
    assert read_vp(spark, path).count() == 1
