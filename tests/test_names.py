from conftest import rows_of, triples_df

from spoframe.functions import column_map, name_variants


def test_name_forms_literal(spark):
    df = spark.createDataFrame([("<http://a.b+c  d>",)], "p string")
    row = name_variants(df).collect()[0]
    assert row["metastore_name"] == "http___a_b_c__d"
    assert row["catalogue_name"] == "http___a_b_c__d"
    assert row["aggregate_key_name"] == "http___a_b_c__d"
    assert row["valid_column_name"] == "http___a_b_c__d"
    assert row["table_name"] == "_http___a_b_c__d_"


def test_metastore_name_trims_edges(spark):
    df = spark.createDataFrame([("< x/y >",), ("\tq\t",)], "p string")
    assert rows_of(name_variants(df), "p", "metastore_name") == [("\tq\t", "q"), ("< x/y >", "x_y")]


def test_bracket_pair_strip_only_when_enclosing(spark):
    df = spark.createDataFrame([("<a>b",), ("<>",), ("<",)], "p string")
    got = dict(rows_of(name_variants(df), "p", "aggregate_key_name"))
    assert got == {"<a>b": "_a_b", "<>": "", "<": "_"}


def test_non_ascii_letters_become_underscore(spark):
    df = spark.createDataFrame([("café",)], "p string")
    assert name_variants(df).collect()[0]["table_name"] == "caf_"


def test_column_map_collisions_case_insensitive():
    got = column_map(["<x/a-b>", "<x/a_b>", "<X/A_B>"])
    assert len(set(v.lower() for v in got.values())) == 3
    assert sorted(got.values(), key=str.lower) == ["X_A_B", "x_a_b_2", "x_a_b_3"]


def test_column_map_never_takes_subject_name():
    assert column_map(["s", "<S>"]) == {"<S>": "S_2", "s": "s_3"}


def test_name_collision_gives_three_property_columns(spark):
    from spoframe.plans import TripleStore

    t = triples_df(spark, [("a", "<x/a-b>", "1"), ("a", "<x/a_b>", "2"), ("a", "<X/A_B>", "3")])
    store = TripleStore.from_triples(t, with_property_table=True)
    assert len(store.property_table.columns) == 4
    row = store.property_table.collect()[0].asDict()
    assert sorted(v for k, v in row.items() if k != "s") == ["1", "2", "3"]


def _java_trim(x):
    i, j = 0, len(x)
    while i < j and ord(x[i]) <= 0x20:
        i += 1
    while j > i and ord(x[j - 1]) <= 0x20:
        j -= 1
    return x[i:j]


def _strip_pair(x):
    return x[1:-1] if len(x) >= 2 and x.startswith("<") and x.endswith(">") else x


def test_name_forms_against_python(spark):
    import random
    import re

    rng = random.Random(7)
    alphabet = list("ab_Z09<>/.:#-+ \t%$éß")
    values = {"".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(300)}
    values = sorted(values | {"", "<", ">", "<>", "<<a>>", " <x> ", "\t<q>\t"})
    word = re.compile(r"[^\w]", re.ASCII)
    expected = {
        v: (
            word.sub("_", v),
            word.sub("_", _java_trim(v.replace("<", "").replace(">", ""))),
            word.sub("_", v.replace("<", "").replace(">", "")),
            word.sub("_", _strip_pair(v)),
            re.sub(r"[^a-zA-Z0-9_]", "_", _strip_pair(v)),
        )
        for v in values
    }
    df = spark.createDataFrame([(v,) for v in values], "p string")
    cols = ["table_name", "metastore_name", "catalogue_name", "aggregate_key_name", "valid_column_name"]
    got = {r["p"]: tuple(r[c] for c in cols) for r in name_variants(df).collect()}
    assert got == expected
