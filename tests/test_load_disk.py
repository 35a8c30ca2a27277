"""What a load leaves on disk and shuffles: tables bucketed by subject are made in place, shuffle files go, texts are compressed."""

import gzip
import os
import re
import time
import uuid
from glob import glob

import pytest
from conftest import rows_of, triples_df

from spoframe.operators import plan_columns, predicate_stats
from spoframe.plans import TripleStore, load_store, load_tables, load_text
from spoframe.plans.store import property_rows
from spoframe.sources import read_triples, text, write_lines, write_triples
from spoframe.sources.tables import TABLE_TRIPLES

#: Lists too long for a chunk and short ones, subjects with lists only and with single values only, duplicates.
ROWS = [(f"s{i % 40}", "a", f"o{i % 7}") for i in range(200)] + [("hub", "b", f"o{i}") for i in range(500)]
ROWS += [(f"s{i}", "one", str(i)) for i in range(30)] + [(f"t{i}", "A.b", "") for i in range(20)]
ROWS += [("s1", "b", "x"), ("", "", "é"), ("s2", None, "x"), (None, "a", "x"), ("s3", "a", None)]


@pytest.fixture(scope="module")
def triples(spark):
    return triples_df(spark, ROWS).cache()


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob(f"{d.getPath()}/*/shuffle_*.data")}


def new_shuffle_files(spark, before):
    """Those that are still there after a while: they are deleted by another thread."""
    for _ in range(40):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.25)
    return left


def loaded(spark, triples, tmp_out, **options):
    name = f"load_disk_{uuid.uuid4().hex}"
    return name, load_tables(triples, name, location=os.path.join(tmp_out, "database"), **options)


def test_bucketed_tables_hold_what_the_folders_hold(spark, triples, tmp_out):
    name, tables = loaded(spark, triples, tmp_out, buckets=3, chunk_values=20)
    try:
        store = load_store(triples, os.path.join(tmp_out, "store"), chunk_values=20)
        for one, other in ((tables.vp, store.vp), (tables.stats, store.stats), (tables.lists, store.lists)):
            assert rows_of(one, *other.columns) == rows_of(other)
        columns = store.property_table.columns
        rows = lambda df: sorted((tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=str)
        assert tables.property_table.columns == columns and tables.pt_columns == store.pt_columns
        assert rows(tables.property_table) == rows(store.property_table)
        # a file for each bucket and predicate at most
        for table in ("triples/*", "lists/*", "property_table"):
            for folder in glob(os.path.join(tmp_out, "database", table)):
                assert len(glob(f"{folder}/*.parquet")) <= 3, folder
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


@pytest.mark.parametrize("predicates", [["a", "b"], ["one", "A.b"], ["a", "one"]])
def test_tables_of_some_predicates(spark, triples, tmp_out, predicates):
    name, tables = loaded(spark, triples, tmp_out, predicates=predicates)
    try:
        store = load_store(triples, os.path.join(tmp_out, "store"), predicates=predicates)
        assert tables.property_table.columns == store.property_table.columns
        assert sorted(map(str, tables.property_table.collect())) == sorted(map(str, store.property_table.collect()))
        assert rows_of(tables.lists, "s", "p", "values") == rows_of(store.lists, "s", "p", "values")
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def test_bucketed_tables_are_made_where_the_rows_lie(spark, triples, tmp_out):
    name, tables = loaded(spark, triples, tmp_out, buckets=3)
    try:
        plan = property_rows(tables.vp, tables.lists, plan_columns(tables.stats), in_place=True)
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        # objects are dealt, and one row a predicate and task: no subject
        plan = predicate_stats(tables.vp, in_place=True)._jdf.queryExecution().executedPlan().toString()
        assert re.findall(r"hashpartitioning\(([a-z#0-9, ]*), \d+\)", plan) and not re.search(r"hashpartitioning\([^)]*s#", plan), plan
        assert rows_of(predicate_stats(tables.vp, in_place=True)) == rows_of(predicate_stats(tables.vp))
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def test_a_load_leaves_no_shuffle_files_and_the_settings(spark, triples, tmp_out):
    settings, before = dict(spark.conf.getAll.items()), shuffle_files(spark)
    name, _ = loaded(spark, triples, tmp_out)
    try:
        assert not new_shuffle_files(spark, before)
        load_store(triples, os.path.join(tmp_out, "store"))
        assert not new_shuffle_files(spark, before)
        assert dict(spark.conf.getAll.items()) == settings
        with pytest.raises(Exception, match="cannot be cast|CAST_INVALID_INPUT"):
            load_tables(triples.selectExpr("cast(s as int) AS s", "p", "o"), f"{name}_2", location=os.path.join(tmp_out, "two"))
        assert dict(spark.conf.getAll.items()) == settings
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {name}_2 CASCADE")
        spark.sql(f"DROP DATABASE {name} CASCADE")
        assert TripleStore.open(spark, os.path.join(tmp_out, "store")).vp.count() == 752


def test_compressed_lines_read_back_and_are_shared_over_files(spark, tmp_out, monkeypatch):
    monkeypatch.setattr(text, "FILE_LINES", 100)
    lines = spark.range(950).selectExpr("concat('s', id, '\tp\té ', id % 3, if(id % 10 = 0, '\r', '')) AS value").coalesce(1)
    odd = spark.createDataFrame([("",), ("one field",), ("a\tb",), ("\t\t",), ("\t\t\tmore",)], "value string").coalesce(1)
    path = os.path.join(tmp_out, "text")
    write_lines(lines, path, compression="gzip")
    write_lines(odd, path, "append", "gzip")
    files = glob(f"{path}/*.gz")
    counts = [len(gzip.open(f).read().split(b"\n")) - 1 for f in files]
    assert sorted(counts) == [5, 50] + [100] * 9 and len(glob(f"{path}/part-*")) == len(files)
    got = read_triples(spark, path)
    assert rows_of(got.rejected) == [("",), ("a\tb",), ("one field",)]
    want = [(f"s{i}", "p", f"é {i % 3}" + ("\r" if i % 10 == 0 else "")) for i in range(950)] + [("", "", "")] * 2
    assert rows_of(got.triples) == sorted(want)


def test_triples_written_compressed_are_the_same(spark, triples, tmp_out):
    some = triples.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
    paths = {kind: os.path.join(tmp_out, kind) for kind in ("none", "gzip")}
    for kind, path in paths.items():
        write_triples(some, path, compression=kind)
    one, other = (rows_of(read_triples(spark, path).triples) for path in paths.values())
    assert one == other and len(one) == 752
    with pytest.raises(Exception, match="NULL or holds a tab"):
        write_triples(triples, os.path.join(tmp_out, "bad"), compression="gzip")


def tables(spark, folder, rows=2000):
    """Tables of the mapping with ``rows`` rows each, and documents."""
    for table, _, key, columns in TABLE_TRIPLES:
        cells = {"date": "date_add(date'2020-01-01', cast(id % 99 AS int))", "text": "concat('some text ', id % 7)"}
        made = [f"{cells.get(kind, 'id % 50')} AS {column}" for _, kind, column in columns]
        spark.range(rows).selectExpr(f"if(id % 100 = 0, null, id) AS {key}", *made).write.parquet(f"{folder}/{table}.parquet", mode="append")
    docs = [("a\tb\tc\nno triple\n",), (None,), ("",), ("x\ty\tz\tw\n\n\t\t",)]
    spark.createDataFrame(docs, "text string").write.parquet(f"{folder}/documents.parquet")


def test_load_accounting_keeps_its_text_compressed_until_it_is_loaded(spark, tmp_out, monkeypatch):
    import __spark_entry__ as entry

    tables(spark, tmp_out)
    triples = entry._triples(spark, tmp_out).cache()
    seen = {}

    def load(spark, path, *args, **options):
        where = path.removeprefix("file:")
        plain = os.path.join(tmp_out, "plain")
        write_triples(triples, plain)
        size = lambda p: sum(os.path.getsize(f) for f in glob(f"{p}/part-*"))
        seen[where] = size(where) / size(plain)
        return load_text(spark, path, *args, **options)

    monkeypatch.setattr(entry, "load_text", load)
    got = entry.queries()["load_accounting"](spark, tmp_out).collect()
    # the documents have three lines of three fields or more; "no triple", an end, an empty document and an empty line are none
    assert [tuple(r) for r in got] == [(triples.count() + 3, 0, 4)]
    [(where, share)] = seen.items()
    assert share < 0.25 and not os.path.exists(where)
