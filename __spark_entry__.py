"""

Every query reads the driver's tables under ``sf_dir``, turns them into
triples (``spoframe.sources.tables``) and works on those triples or on the
layouts written from them.  The stored layouts (partitioned rows,
statistics, catalogue, property table) are written once per Spark
application and data directory under the shared folder
(``spark.checkpoint.dir``) and reused by later queries, as a loaded store
would be.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoframe.functions.names import name_variants
from spoframe.operators import (
    Var,
    distinct_predicates,
    graph_stats,
    list_chunks,
    lookup_stats,
    multivalued_predicates,
    plan_columns,
    predicate_catalogue,
    predicate_profile,
    predicate_stats,
    properties_array,
    property_table,
    scan_pattern,
    semijoin,
    single_valued_predicates,
)
from spoframe.plans import (
    TripleStore,
    load_store,
    load_tables,
    load_text,
    match,
    match_all,
    tagged_union,
    write_all,
)
from spoframe.session import Scratch, application_id, fresh_path, task_count, written
from spoframe.sources import (
    predicate as P,
    read_property_table,
    read_result,
    read_stats,
    read_triples,
    read_vp,
    scan_vp,
    triples_from_tables,
    write_lines,
    write_property_table,
    write_result,
    write_stats,
    write_triples,
    write_vp,
)
from spoframe.sources.tables import TABLE_TRIPLES

try:  # the corpus operators are optional: everything else works without them
    import corpus_pipeline
    from spoframe.llm import queries as corpus_queries
except ModuleNotFoundError as e:
    # only their absence is excused; a broken module or dependency is an error
    if e.name not in ("corpus_pipeline", "spoframe.llm", "spoframe.llm.queries"):
        raise
    corpus_pipeline = corpus_queries = None

SMOKE_DIR = "/root/testdata/sf0.001"

# --------------------------------------------------------------------------
# Query patterns (variables by name; predicates by their mapping NAME)

o, c, n, r, st, p, t, s, x, b, z, sg, nm, pr = map(
    Var, ["o", "c", "n", "r", "st", "p", "t", "s", "x", "b", "z", "sg", "nm", "pr"]
)

CHAIN = [(o, P("placedBy"), c), (c, P("segment"), "BUILDING"), (c, P("inNation"), n)]
SNOWFLAKE = [
    (o, P("placedBy"), c),
    (c, P("inNation"), n),
    (n, P("inRegion"), r),
    (r, P("name"), "ASIA"),
    (o, P("status"), st),
]
MIXED = [
    (o, P("status"), "F"),
    (o, P("placedBy"), c),
    (o, P("hasPart"), p),
    (p, P("brand"), "Brand#7"),
    (p, P("type"), t),
    (c, P("segment"), "BUILDING"),
]
CYCLE = [(o, P("placedBy"), c), (c, P("inNation"), n), (o, P("hasSupplier"), s), (s, P("inNation"), n)]
STAR_CONST_SINGLE = [(p, P("brand"), "Brand#7"), (p, P("type"), t)]
STAR_EXPLODE = [(o, P("status"), "F"), (o, P("placedBy"), c), (o, P("hasPart"), p)]
STAR_TWO_EXPLODES = [(o, P("priority"), "1-URGENT"), (o, P("hasPart"), p), (o, P("hasSupplier"), s)]
# only the order is asked for: the rest has to exist
EXISTS_ONLY = [(o, P("status"), "F"), (o, P("hasPart"), p), (o, P("hasSupplier"), s), (o, P("placedBy"), c)]
# a triangle whose closing edges hold three values of st in all
CYCLE_HEAVY = [(o, P("placedBy"), c), (c, P("orderedWith"), st), (o, P("status"), st)]
# the orders of each status that has urgent ones, and their customers
HUB = [(x, P("statusOf"), o), (x, P("statusPriority"), "1-URGENT"), (o, P("placedBy"), c)]
CONST_SUBJECT = [("order/100", P("status"), st), ("order/100", P("placedBy"), c), ("order/100", P("hasPart"), p)]
# two queries with a scan in common, under different variable names
SHARED_BATCH = {
    "chain": (CHAIN, ["o", "n"]),
    "segment_orders": ([(x, P("segment"), "BUILDING"), (o, P("placedBy"), x), (o, P("status"), "F")], ["o", "x"]),
    "finished": ([(r, P("status"), "F"), (r, P("placedBy"), c)], ["r", "c"]),
}


# --------------------------------------------------------------------------
# Shared inputs

_STORES: dict[tuple[str, str], tuple[str, TripleStore]] = {}


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples_from_tables(spark, sf_dir)


def _store_entry(spark: SparkSession, sf_dir: str) -> tuple[str, TripleStore]:
    key = (application_id(spark), os.path.abspath(sf_dir))
    if key not in _STORES:
        base = fresh_path(spark, "store")
        _STORES[key] = (base, load_store(_triples(spark, sf_dir), base))
    return _STORES[key]


def _store(spark: SparkSession, sf_dir: str) -> TripleStore:
    """The layouts written from ``sf_dir``'s triples (once per application)."""
    return _store_entry(spark, sf_dir)[1]


def _tasks(store: TripleStore) -> int:
    """Tasks for a shuffle of a store's triples."""
    return task_count(store.manifest["triples"])


def _stats(triples: DataFrame) -> DataFrame:
    return predicate_stats(triples, task_count(triples.count()))


def _hub_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every status as a subject with all its orders and their priorities, and every order with its customer."""
    triples = _triples(spark, sf_dir)
    status = triples.where(F.col("p") == P("status"))
    hubs = status.select(F.col("o").alias("s"), F.lit(P("statusOf")).alias("p"), F.col("s").alias("o"))
    priority = triples.where(F.col("p") == P("priority")).select("s", F.col("o").alias("priority"))
    with_priority = status.join(priority, "s").select(
        F.col("o").alias("s"), F.lit(P("statusPriority")).alias("p"), F.col("priority").alias("o")
    )
    return hubs.unionByName(with_priority).unionByName(triples.where(F.col("p") == P("placedBy")))


def _render_lists(df: DataFrame) -> DataFrame:
    """Array columns as ``a|b|c`` (sorted) so results compare as text."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "array":
            cols.append(F.array_join(F.array_sort(F.col(f.name)), "|").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# --------------------------------------------------------------------------
# Queries


def q_triple_source(spark, sf_dir):
    path = fresh_path(spark, "triples-tsv")
    write_triples(_triples(spark, sf_dir), path)
    return read_triples(spark, path).triples


def q_distinct_predicates(spark, sf_dir):
    return distinct_predicates(_triples(spark, sf_dir))


def q_multivalued_predicates(spark, sf_dir):
    return multivalued_predicates(_triples(spark, sf_dir))


def q_single_valued_predicates(spark, sf_dir):
    return single_valued_predicates(_triples(spark, sf_dir))


def q_predicate_catalogue(spark, sf_dir):
    return predicate_catalogue(_triples(spark, sf_dir))


def q_predicate_stats(spark, sf_dir):
    return _stats(_triples(spark, sf_dir))


def q_graph_stats(spark, sf_dir):
    store = _store(spark, sf_dir)
    return graph_stats(store.vp, store.stats, _tasks(store))


def q_predicate_profile(spark, sf_dir):
    return predicate_profile(_stats(_triples(spark, sf_dir)))


def q_stats_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "stats")
    write_stats(_stats(_triples(spark, sf_dir)), path)
    return read_stats(spark, path)


def q_stats_lookup(spark, sf_dir):
    store = _store(spark, sf_dir)
    wanted = store.vp.sparkSession.createDataFrame(
        [(P(name),) for name in ("placedBy", "inNation", "hasPart", "nope")], "p string"
    )
    return lookup_stats(store.stats, wanted)


def q_vp_scan(spark, sf_dir):
    return scan_vp(_store(spark, sf_dir).vp, P("hasPart"))


def q_vp_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "vp")
    write_vp(_triples(spark, sf_dir), path)
    return read_vp(spark, path).select("s", "o", "p")


def q_pattern_var_var(spark, sf_dir):
    return match(_store(spark, sf_dir), [(x, P("inNation"), n)])


def q_pattern_const_object(spark, sf_dir):
    return match(_store(spark, sf_dir), [(c, P("segment"), "BUILDING")])


def q_pattern_const_subject(spark, sf_dir):
    return match(_store(spark, sf_dir), [("order/100", P("hasPart"), p)])


def q_pattern_exists(spark, sf_dir):
    return match(_store(spark, sf_dir), [("region/2", P("name"), "ASIA"), (n, P("inRegion"), "region/2")])


def q_pattern_exists_false(spark, sf_dir):
    return match(_store(spark, sf_dir), [("region/2", P("name"), "EUROPE"), (n, P("inRegion"), "region/2")])


def q_pattern_scan_rows(spark, sf_dir):
    store = _store(spark, sf_dir)
    return scan_pattern(store.rows(P("hasSupplier")), (o, P("hasSupplier"), s))


def q_name_clean_variants(spark, sf_dir):
    return name_variants(distinct_predicates(_triples(spark, sf_dir)))


def q_property_table(spark, sf_dir):
    """The explicit table with whole lists, from the stored rows."""
    store = _store(spark, sf_dir)
    return _render_lists(property_table(store.vp, list(store.pt_columns.values()), _tasks(store)))


def q_property_table_stored(spark, sf_dir):
    """The stored table: values of single-valued predicates, numbers of values of the others."""
    return _store(spark, sf_dir).property_table


def q_properties_array(spark, sf_dir):
    triples = _triples(spark, sf_dir)
    store = _store(spark, sf_dir)
    preds = sorted(store.pt_columns)
    cell = lambda a: F.coalesce(F.array_join(F.array_sort(a), "|"), F.lit("NULL"))
    return properties_array(triples, preds, _tasks(store)).select(
        "s", F.array_join(F.transform("props", cell), ";").alias("props")
    )


def q_pt_roundtrip(spark, sf_dir):
    triples = _triples(spark, sf_dir)
    path = fresh_path(spark, "property-table")
    tasks = task_count(triples.count())
    columns = plan_columns(predicate_stats(triples, tasks))
    write_property_table(property_table(triples, columns, tasks, ranged=True), path, ranged=True)
    return _render_lists(read_property_table(spark, path))


def q_pt_scan(spark, sf_dir):
    store = _store(spark, sf_dir)
    return store.property_table.select("s", store.pt_columns[P("brand")].column)


def q_star_scan(spark, sf_dir):
    pats = [(p, P("brand"), b), (p, P("type"), t), (p, P("size"), z)]
    return match(_store(spark, sf_dir), pats, layout="mixed")


def q_star_const_single(spark, sf_dir):
    return match(_store(spark, sf_dir), STAR_CONST_SINGLE, layout="mixed")


def q_star_array_contains(spark, sf_dir):
    return match(_store(spark, sf_dir), [(o, P("hasSupplier"), "supplier/7")], layout="mixed", min_group_size=1)


def q_star_single_var(spark, sf_dir):
    pats = [(c, P("segment"), sg), (c, P("inNation"), n)]
    return match(_store(spark, sf_dir), pats, layout="mixed")


def q_star_explode(spark, sf_dir):
    return match(_store(spark, sf_dir), STAR_EXPLODE, layout="mixed")


def q_star_two_explodes(spark, sf_dir):
    return match(_store(spark, sf_dir), STAR_TWO_EXPLODES, layout="mixed")


def q_join_chain(spark, sf_dir):
    return match(_store(spark, sf_dir), CHAIN, ["o", "n"], use_stats=False)


def q_join_snowflake(spark, sf_dir):
    return match(_store(spark, sf_dir), SNOWFLAKE, ["o", "n", "st"], use_stats=False)


def q_semijoin_up(spark, sf_dir):
    store = _store(spark, sf_dir)
    placed = scan_pattern(store.rows(P("placedBy")), (o, P("placedBy"), c))
    building = scan_pattern(store.rows(P("segment")), (c, P("segment"), "BUILDING"))
    return semijoin(placed, building)


def q_semijoin_down(spark, sf_dir):
    store = _store(spark, sf_dir)
    names = scan_pattern(store.rows(P("name")), (c, P("name"), x))
    placed = scan_pattern(store.rows(P("placedBy")), (o, P("placedBy"), c))
    finished = scan_pattern(store.rows(P("status")), (o, P("status"), "F"))
    return semijoin(names, semijoin(placed, finished))


def q_join_reduced(spark, sf_dir):
    return match(_store(spark, sf_dir), CHAIN, ["o", "n"], reduce=True)


def q_join_reduced_auto(spark, sf_dir):
    return match(_store(spark, sf_dir), CYCLE, ["o", "c", "s", "n"], reduce="auto")


def q_catalogue_roundtrip(spark, sf_dir):
    from spoframe.sources import read_catalogue

    return read_catalogue(spark, os.path.join(_store(spark, sf_dir).folder, "catalogue"))


def q_property_table_hub(spark, sf_dir):
    """The values of hub subjects (and of all others) as chunk rows."""
    chunks = list_chunks(_hub_triples(spark, sf_dir))
    joined = lambda name: F.array_join(F.col(name).cast("array<string>"), "|").alias(name)
    return chunks.select("s", "p", "chunk", joined("values"), joined("counts"))


def q_bgp_mixed_hub(spark, sf_dir):
    """A star on hub subjects: a list variable and a list constant, joined on."""
    store = load_store(_hub_triples(spark, sf_dir), fresh_path(spark, "hub-store"))
    return match(store, HUB, ["x", "o", "c"], layout="mixed")


def q_bgp_exists_only(spark, sf_dir):
    return match(_store(spark, sf_dir), EXISTS_ONLY, ["o"], layout="mixed")


def q_bgp_exists_only_vp(spark, sf_dir):
    return match(_store(spark, sf_dir), EXISTS_ONLY, ["o"])


def q_bgp_cycle_heavy(spark, sf_dir):
    """A triangle whose closing edges share three values: each value is joined along its cheapest side."""
    triples = _triples(spark, sf_dir).where(F.col("p").isin(P("placedBy"), P("status")))
    placed = triples.where(F.col("p") == P("placedBy")).select("s", F.col("o").alias("c"))
    status = triples.where(F.col("p") == P("status")).select("s", F.col("o").alias("st"))
    ordered = placed.join(status, "s").select(F.col("c").alias("s"), F.lit(P("orderedWith")).alias("p"), F.col("st").alias("o"))
    edges = written(triples.unionByName(ordered.distinct()), "cycle-edges")
    return match(TripleStore.from_triples(edges), CYCLE_HEAVY, ["o", "c", "st"])


def q_store_tables(spark, sf_dir):
    """A star over partitioned rows of a store kept as named, bucketed tables."""
    database = f"spoframe_{uuid.uuid4().hex}"
    load_tables(_triples(spark, sf_dir), database, location=fresh_path(spark, "database"))
    store = TripleStore.open_database(spark, database)
    return match(store, [(o, P("status"), st), (o, P("placedBy"), c), (o, P("hasPart"), p)])


def q_pt_const_subject(spark, sf_dir):
    """A star of one subject: the file index names the property table's file to open."""
    return match(_store(spark, sf_dir), CONST_SUBJECT, layout="mixed")


def q_batch_shared_scans(spark, sf_dir):
    """Queries with scans in common: each is run once and written for all sinks."""
    paths = write_all(match_all(_store(spark, sf_dir), SHARED_BATCH), fresh_path(spark, "batch"))
    return tagged_union({name: read_result(spark, path) for name, path in paths.items()})


def q_load_accounting(spark, sf_dir):
    """Triples and the lines of all documents as one text: rows loaded and lines rejected, from the manifest."""
    with Scratch(spark) as scratch:  # the text is several times the tables': it is compressed, and goes when it is loaded
        path = scratch.place("triples-tsv")
        write_triples(_triples(spark, sf_dir), path, compression="gzip")
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
        write_lines(docs.select(F.explode(F.split("text", "\n")).alias("value")), path, "append", "gzip")
        store = load_text(spark, path, fresh_path(spark, "store"), with_property_table=False)
    counts = {k: store.manifest[k] for k in ("triples", "null_rows", "rejected_lines")}
    return spark.createDataFrame([counts], "triples long, null_rows long, rejected_lines long")


def q_name_variants_text(spark, sf_dir):
    """The name forms of arbitrary text: every page address, document and turn of a conversation."""
    parts = [("pages", "url"), ("documents", "text"), ("conversations", "text")]
    read = [spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(c).alias("p")) for t, c in parts]
    names = name_variants(read[0].unionByName(read[1]).unionByName(read[2]).where("p IS NOT NULL").distinct())
    return names.select(*[F.md5(c).alias(c) for c in names.columns])


def q_store_reload(spark, sf_dir):
    """A store loaded twice, the second time without a property table: the second load's rows."""
    base = fresh_path(spark, "store")
    triples = _triples(spark, sf_dir)
    load_store(triples.where(F.col("p").isin(P("brand"), P("type"))), base)
    rest = triples.where(F.col("p").isin(P("segment"), P("inNation")))
    store = load_store(rest, base, with_property_table=False, mode="overwrite")
    return match(store, [(c, P("segment"), sg), (c, P("inNation"), n)], layout="mixed")


def q_bgp_repeated_constant(spark, sf_dir):
    """One constant in two patterns that only variables connect."""
    pats = [(o, P("status"), "F"), (o, P("placedBy"), c), (x, P("placedBy"), c), (x, P("status"), "F")]
    return match(_store(spark, sf_dir), pats, ["o", "x"], use_stats=False)


def q_batch_sinks(spark, sf_dir):
    """The batch with one written result a query, read back."""
    batch = {"join_chain": (CHAIN, ["o", "n"]), "star_const_single": (STAR_CONST_SINGLE, ["p", "t"])}
    paths = write_all(match_all(_store(spark, sf_dir), batch, layout="mixed"), fresh_path(spark, "batch"))
    return tagged_union({name: read_result(spark, path) for name, path in paths.items()})


def q_bgp_vp(spark, sf_dir):
    return match(_store(spark, sf_dir), SNOWFLAKE, ["o", "n", "st"])


def q_bgp_mixed(spark, sf_dir):
    return match(_store(spark, sf_dir), MIXED, ["o", "c", "p", "t"], layout="mixed")


def q_bgp_mixed_reduced(spark, sf_dir):
    return match(_store(spark, sf_dir), MIXED, ["o", "c", "p", "t"], layout="mixed", reduce=True)


def q_bgp_group3(spark, sf_dir):
    return match(_store(spark, sf_dir), MIXED, ["o", "c", "p", "t"], layout="mixed", min_group_size=3)


def q_bgp_cycle(spark, sf_dir):
    return match(_store(spark, sf_dir), CYCLE, ["o", "c", "s", "n"])


def q_bgp_cycle_mixed(spark, sf_dir):
    return match(_store(spark, sf_dir), CYCLE, ["o", "c", "s", "n"], layout="mixed", reduce=True)


def q_batch_match(spark, sf_dir):
    batch = {
        "join_chain": (CHAIN, ["o", "n"]),
        "star_const_single": (STAR_CONST_SINGLE, ["p", "t"]),
        "bgp_cycle": (CYCLE, ["o", "c", "s", "n"]),
    }
    return tagged_union(match_all(_store(spark, sf_dir), batch, layout="mixed"))


def q_result_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "result")
    write_result(match(_store(spark, sf_dir), CHAIN, ["o", "n"]), path)
    return read_result(spark, path)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the six-pattern query over both layouts, at sf0.001."""
    return q_bgp_mixed(spark, SMOKE_DIR)


def own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries that need none of the optional subpackages."""
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return own_queries() | (corpus_queries.queries() | {"pipeline": corpus_pipeline.run} if corpus_queries else {})


# --------------------------------------------------------------------------
# DuckDB oracle


def _triples_sql() -> str:
    parts = []
    for table, entity, key, columns in TABLE_TRIPLES:
        subject = f"'{entity}/' || CAST({key} AS VARCHAR)"
        for name, kind, column in columns:
            if kind == "text":
                obj = f"CAST({column} AS VARCHAR)"
            elif kind == "date":
                obj = f"strftime({column}, '%Y-%m-%d')"
            else:
                obj = f"'{kind[4:]}/' || CAST({column} AS VARCHAR)"
            parts.append(
                f"SELECT {subject} AS s, '{P(name)}' AS p, {obj} AS o FROM {table} "
                f"WHERE {key} IS NOT NULL AND {column} IS NOT NULL"
            )
    return "WITH triples AS (\n  " + "\n  UNION ALL\n  ".join(parts) + "\n)"


def _pred(name: str) -> str:
    return f"(SELECT s, o FROM triples WHERE p = '{P(name)}')"


# Which mapping NAMEs are multi-valued in the test data.
_MULTI = {"did", "hasPart", "hasSupplier"}
_NAMES = sorted({name for _, _, _, cols in TABLE_TRIPLES for name, _, _ in cols})


def _column(name: str) -> str:
    return f"http___ex_org_{name}"


_PT_SQL = (
    "SELECT s, "
    + ", ".join(
        (
            f"string_agg(CASE WHEN p = '{P(nm)}' THEN o END, '|' ORDER BY o) AS {_column(nm)}"
            if nm in _MULTI
            else f"max(CASE WHEN p = '{P(nm)}' THEN o END) AS {_column(nm)}"
        )
        for nm in _NAMES
    )
    + " FROM triples GROUP BY s"
)

_STATS_SQL = (
    "SELECT p, size, distinct_subjects, distinct_objects, max_multiplicity, is_complex FROM "
    "(SELECT p, CAST(sum(k) AS BIGINT) AS size, count(*) AS distinct_subjects, "
    "max(k) AS max_multiplicity, sum(k) > count(*) AS is_complex "
    "FROM (SELECT p, s, count(*) AS k FROM triples GROUP BY p, s) GROUP BY p) "
    "JOIN (SELECT p, count(DISTINCT o) AS distinct_objects FROM triples GROUP BY p) USING (p)"
)
_MULTI_SQL = "SELECT DISTINCT p FROM (SELECT s, p FROM triples GROUP BY s, p HAVING count(*) > 1)"

_CHAIN_SQL = (
    f"SELECT DISTINCT pb.s AS o, nat.o AS n FROM {_pred('placedBy')} pb "
    f"JOIN {_pred('segment')} seg ON seg.s = pb.o AND seg.o = 'BUILDING' "
    f"JOIN {_pred('inNation')} nat ON nat.s = pb.o"
)
_SNOWFLAKE_SQL = (
    f"SELECT DISTINCT pb.s AS o, nat.o AS n, stt.o AS st FROM {_pred('placedBy')} pb "
    f"JOIN {_pred('inNation')} nat ON nat.s = pb.o "
    f"JOIN {_pred('inRegion')} reg ON reg.s = nat.o "
    f"JOIN {_pred('name')} rn ON rn.s = reg.o AND rn.o = 'ASIA' "
    f"JOIN {_pred('status')} stt ON stt.s = pb.s"
)
_MIXED_SQL = (
    f"SELECT DISTINCT sts.s AS o, pb.o AS c, hp.o AS p, ty.o AS t FROM {_pred('status')} sts "
    f"JOIN {_pred('placedBy')} pb ON pb.s = sts.s "
    f"JOIN {_pred('hasPart')} hp ON hp.s = sts.s "
    f"JOIN {_pred('brand')} br ON br.s = hp.o AND br.o = 'Brand#7' "
    f"JOIN {_pred('type')} ty ON ty.s = hp.o "
    f"JOIN {_pred('segment')} seg ON seg.s = pb.o AND seg.o = 'BUILDING' "
    "WHERE sts.o = 'F'"
)
_CYCLE_SQL = (
    f"SELECT DISTINCT pb.s AS o, pb.o AS c, hs.o AS s, cn.o AS n FROM {_pred('placedBy')} pb "
    f"JOIN {_pred('inNation')} cn ON cn.s = pb.o "
    f"JOIN {_pred('hasSupplier')} hs ON hs.s = pb.s "
    f"JOIN {_pred('inNation')} sn ON sn.s = hs.o AND sn.o = cn.o"
)
_STAR_CONST_SINGLE_SQL = (
    f"SELECT DISTINCT br.s AS p, ty.o AS t FROM {_pred('brand')} br "
    f"JOIN {_pred('type')} ty ON ty.s = br.s WHERE br.o = 'Brand#7'"
)


_EXISTS_SQL = (
    f"SELECT DISTINCT s AS o FROM {_pred('status')} WHERE o = 'F' AND s IN (SELECT s FROM {_pred('hasPart')}) "
    f"AND s IN (SELECT s FROM {_pred('hasSupplier')}) AND s IN (SELECT s FROM {_pred('placedBy')})"
)
_HUB_SQL = (
    f"SELECT o AS s, '{P('statusOf')}' AS p, s AS o FROM {_pred('status')} UNION ALL "
    f"SELECT st.o AS s, '{P('statusPriority')}' AS p, pr.o AS o FROM {_pred('status')} st "
    f"JOIN {_pred('priority')} pr ON pr.s = st.s UNION ALL "
    f"SELECT s, '{P('placedBy')}' AS p, o FROM {_pred('placedBy')}"
)


def _name_forms_sql(source: str = "SELECT DISTINCT p FROM triples") -> str:
    strip = "CASE WHEN p LIKE '<%>' AND length(p) >= 2 THEN substr(p, 2, length(p) - 2) ELSE p END"
    return (
        "SELECT p, "
        "regexp_replace(p, '[^\\w]', '_', 'g') AS table_name, "
        "regexp_replace(regexp_replace(translate(p, '<>', ''), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), "
        "'[^\\w]', '_', 'g') AS metastore_name, "
        "regexp_replace(translate(p, '<>', ''), '[^\\w]', '_', 'g') AS catalogue_name, "
        f"regexp_replace({strip}, '[^\\w]', '_', 'g') AS aggregate_key_name, "
        f"regexp_replace({strip}, '[^a-zA-Z0-9_]', '_', 'g') AS valid_column_name "
        f"FROM ({source})"
    )


def _properties_array_sql() -> str:
    cells = ", ".join(
        f"coalesce(string_agg(CASE WHEN p = '{P(nm)}' THEN o END, '|' ORDER BY o), 'NULL')"
        for nm in sorted(_NAMES, key=P)
    )
    return f"SELECT s, concat_ws(';', {cells}) AS props FROM triples GROUP BY s"


def oracle_sql() -> dict[str, str]:
    w = _triples_sql() + "\n"
    q = {
        "triple_source": "SELECT s, p, o FROM triples",
        "distinct_predicates": "SELECT DISTINCT p FROM triples",
        "multivalued_predicates": _MULTI_SQL,
        "single_valued_predicates": f"SELECT DISTINCT p FROM triples EXCEPT {_MULTI_SQL}",
        "predicate_catalogue": (
            "SELECT p, CASE WHEN max(k) > 1 THEN 1 ELSE 0 END AS is_complex "
            "FROM (SELECT p, s, count(*) AS k FROM triples GROUP BY p, s) GROUP BY p"
        ),
        "predicate_stats": _STATS_SQL,
        "graph_stats": (
            "SELECT count(*) AS size, count(DISTINCT s) AS distinct_subjects, "
            "count(DISTINCT p) AS predicates FROM triples"
        ),
        "predicate_profile": (
            "SELECT p, size, distinct_subjects, is_complex, "
            "round(size / distinct_subjects, 4) AS avg_multiplicity, "
            "round(size * ln(distinct_subjects) / ln(1.2), 4) AS cost "
            f"FROM ({_STATS_SQL})"
        ),
        "stats_roundtrip": _STATS_SQL,
        "stats_lookup": (
            "SELECT w.p, coalesce(st.size, -1) AS size, coalesce(st.distinct_subjects, -1) AS distinct_subjects, "
            f"st.is_complex FROM (VALUES ('{P('placedBy')}'), ('{P('inNation')}'), ('{P('hasPart')}'), "
            f"('{P('nope')}')) w(p) LEFT JOIN ({_STATS_SQL}) st ON st.p = w.p"
        ),
        "vp_scan": f"SELECT s, o FROM triples WHERE p = '{P('hasPart')}'",
        "vp_roundtrip": "SELECT s, o, p FROM triples",
        "pattern_var_var": f"SELECT DISTINCT s AS x, o AS n FROM {_pred('inNation')}",
        "pattern_const_object": f"SELECT DISTINCT s AS c FROM {_pred('segment')} WHERE o = 'BUILDING'",
        "pattern_const_subject": f"SELECT DISTINCT o AS p FROM {_pred('hasPart')} WHERE s = 'order/100'",
        "pattern_exists": (
            f"SELECT DISTINCT s AS n FROM {_pred('inRegion')} WHERE o = 'region/2' AND EXISTS "
            f"(SELECT 1 FROM {_pred('name')} WHERE s = 'region/2' AND o = 'ASIA')"
        ),
        "pattern_exists_false": (
            f"SELECT DISTINCT s AS n FROM {_pred('inRegion')} WHERE o = 'region/2' AND EXISTS "
            f"(SELECT 1 FROM {_pred('name')} WHERE s = 'region/2' AND o = 'EUROPE')"
        ),
        "pattern_scan_rows": f"SELECT s AS o, o AS s FROM {_pred('hasSupplier')}",
        "name_clean_variants": _name_forms_sql(),
        "property_table": _PT_SQL,
        "properties_array": _properties_array_sql(),
        "pt_roundtrip": _PT_SQL,
        "pt_scan": (
            f"SELECT subj.s, br.o AS {_column('brand')} FROM (SELECT DISTINCT s FROM triples) subj "
            f"LEFT JOIN {_pred('brand')} br ON br.s = subj.s"
        ),
        "star_scan": (
            f"SELECT DISTINCT br.s AS p, br.o AS b, ty.o AS t, sz.o AS z FROM {_pred('brand')} br "
            f"JOIN {_pred('type')} ty ON ty.s = br.s JOIN {_pred('size')} sz ON sz.s = br.s"
        ),
        "star_const_single": _STAR_CONST_SINGLE_SQL,
        "star_array_contains": f"SELECT DISTINCT s AS o FROM {_pred('hasSupplier')} WHERE o = 'supplier/7'",
        "star_single_var": (
            f"SELECT DISTINCT sg.s AS c, sg.o AS sg, nat.o AS n FROM {_pred('segment')} sg "
            f"JOIN {_pred('inNation')} nat ON nat.s = sg.s"
        ),
        "star_explode": (
            f"SELECT DISTINCT sts.s AS o, pb.o AS c, hp.o AS p FROM {_pred('status')} sts "
            f"JOIN {_pred('placedBy')} pb ON pb.s = sts.s JOIN {_pred('hasPart')} hp ON hp.s = sts.s "
            "WHERE sts.o = 'F'"
        ),
        "star_two_explodes": (
            f"SELECT DISTINCT pr.s AS o, hp.o AS p, hs.o AS s FROM {_pred('priority')} pr "
            f"JOIN {_pred('hasPart')} hp ON hp.s = pr.s JOIN {_pred('hasSupplier')} hs ON hs.s = pr.s "
            "WHERE pr.o = '1-URGENT'"
        ),
        "join_chain": _CHAIN_SQL,
        "join_snowflake": _SNOWFLAKE_SQL,
        "semijoin_up": (
            f"SELECT pb.s AS o, pb.o AS c FROM {_pred('placedBy')} pb WHERE pb.o IN "
            f"(SELECT s FROM {_pred('segment')} WHERE o = 'BUILDING')"
        ),
        "semijoin_down": (
            f"SELECT nm.s AS c, nm.o AS x FROM {_pred('name')} nm WHERE nm.s IN "
            f"(SELECT pb.o FROM {_pred('placedBy')} pb WHERE pb.s IN "
            f"(SELECT s FROM {_pred('status')} WHERE o = 'F'))"
        ),
        "join_reduced": _CHAIN_SQL,
        "join_reduced_auto": _CYCLE_SQL,
        "catalogue_roundtrip": (
            "SELECT p, 'http___ex_org_' || substr(p, 16, length(p) - 16) AS column, "
            "CASE WHEN max(k) > 1 THEN 1 ELSE 0 END AS is_complex "
            "FROM (SELECT p, s, count(*) AS k FROM triples GROUP BY p, s) GROUP BY p"
        ),
        "bgp_vp": _SNOWFLAKE_SQL,
        "bgp_mixed": _MIXED_SQL,
        "bgp_mixed_reduced": _MIXED_SQL,
        "bgp_group3": _MIXED_SQL,
        "bgp_cycle": _CYCLE_SQL,
        "bgp_cycle_mixed": _CYCLE_SQL,
        "batch_match": (
            f"SELECT 'join_chain' AS query, * FROM ({_CHAIN_SQL}) "
            f"UNION ALL BY NAME SELECT 'star_const_single' AS query, * FROM ({_STAR_CONST_SINGLE_SQL}) "
            f"UNION ALL BY NAME SELECT 'bgp_cycle' AS query, * FROM ({_CYCLE_SQL})"
        ),
        "result_roundtrip": _CHAIN_SQL,
        "property_table_stored": (
            "SELECT s, "
            + ", ".join(
                f"nullif(count(CASE WHEN p = '{P(nm)}' THEN o END), 0) AS {_column(nm)}"
                if nm in _MULTI
                else f"max(CASE WHEN p = '{P(nm)}' THEN o END) AS {_column(nm)}"
                for nm in _NAMES
            )
            + " FROM triples GROUP BY s"
        ),
        "property_table_hub": (
            f"SELECT s, p, chunk, string_agg(o, '|' ORDER BY o) AS values, "
            "string_agg(CAST(k AS VARCHAR), '|' ORDER BY o) AS counts FROM ("
            "SELECT s, p, o, k, CASE WHEN n > 1000 THEN "
            "CAST('0x' || substr(md5(o), 1, 8) AS BIGINT) % CAST(ceil(n / 1000) AS BIGINT) ELSE 0 END AS chunk FROM ("
            f"SELECT s, p, o, count(*) AS k FROM ({_HUB_SQL}) GROUP BY s, p, o) JOIN ("
            f"SELECT s, p, count(*) AS n FROM ({_HUB_SQL}) GROUP BY s, p) USING (s, p)) GROUP BY s, p, chunk"
        ),
        "bgp_mixed_hub": (
            f"SELECT DISTINCT st.o AS x, st.s AS o, pb.o AS c FROM {_pred('status')} st "
            f"JOIN {_pred('placedBy')} pb ON pb.s = st.s WHERE st.o IN (SELECT st2.o FROM {_pred('status')} st2 "
            f"JOIN {_pred('priority')} pr ON pr.s = st2.s WHERE pr.o = '1-URGENT')"
        ),
        "bgp_exists_only": _EXISTS_SQL,
        "bgp_exists_only_vp": _EXISTS_SQL,
        "bgp_cycle_heavy": (
            f"SELECT DISTINCT pb.s AS o, pb.o AS c, st.o AS st FROM {_pred('placedBy')} pb "
            f"JOIN {_pred('status')} st ON st.s = pb.s JOIN (SELECT pb2.o AS c, st2.o AS st FROM {_pred('placedBy')} pb2 "
            f"JOIN {_pred('status')} st2 ON st2.s = pb2.s) ow ON ow.c = pb.o AND ow.st = st.o"
        ),
        "store_tables": (
            f"SELECT DISTINCT sts.s AS o, sts.o AS st, pb.o AS c, hp.o AS p FROM {_pred('status')} sts "
            f"JOIN {_pred('placedBy')} pb ON pb.s = sts.s JOIN {_pred('hasPart')} hp ON hp.s = sts.s"
        ),
        "pt_const_subject": (
            f"SELECT DISTINCT sts.o AS st, pb.o AS c, hp.o AS p FROM {_pred('status')} sts "
            f"JOIN {_pred('placedBy')} pb ON pb.s = sts.s JOIN {_pred('hasPart')} hp ON hp.s = sts.s "
            "WHERE sts.s = 'order/100'"
        ),
        "batch_shared_scans": (
            f"SELECT 'chain' AS query, * FROM ({_CHAIN_SQL}) UNION ALL BY NAME "
            f"SELECT 'segment_orders' AS query, * FROM (SELECT DISTINCT pb.s AS o, pb.o AS x FROM {_pred('placedBy')} pb "
            f"JOIN {_pred('segment')} seg ON seg.s = pb.o AND seg.o = 'BUILDING' "
            f"JOIN {_pred('status')} sts ON sts.s = pb.s AND sts.o = 'F') UNION ALL BY NAME "
            f"SELECT 'finished' AS query, * FROM (SELECT DISTINCT sts.s AS r, pb.o AS c FROM {_pred('status')} sts "
            f"JOIN {_pred('placedBy')} pb ON pb.s = sts.s WHERE sts.o = 'F')"
        ),
        "load_accounting": (
            "SELECT (SELECT count(*) FROM triples) + count(CASE WHEN tabs >= 2 THEN 1 END) AS triples, "
            "CAST(0 AS BIGINT) AS null_rows, count(CASE WHEN tabs < 2 THEN 1 END) AS rejected_lines FROM ("
            "SELECT length(line) - length(replace(line, chr(9), '')) AS tabs FROM ("
            "SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL))"
        ),
        "name_variants_text": (
            "SELECT md5(p) AS p, md5(table_name) AS table_name, md5(metastore_name) AS metastore_name, "
            "md5(catalogue_name) AS catalogue_name, md5(aggregate_key_name) AS aggregate_key_name, "
            "md5(valid_column_name) AS valid_column_name FROM ("
            + _name_forms_sql(
                "SELECT DISTINCT p FROM (SELECT url AS p FROM pages UNION ALL SELECT text FROM documents "
                "UNION ALL SELECT text FROM conversations) WHERE p IS NOT NULL"
            )
            + ")"
        ),
        "store_reload": (
            f"SELECT DISTINCT sg.s AS c, sg.o AS sg, nat.o AS n FROM {_pred('segment')} sg "
            f"JOIN {_pred('inNation')} nat ON nat.s = sg.s"
        ),
        "bgp_repeated_constant": (
            f"SELECT DISTINCT a.s AS o, b.s AS x FROM {_pred('placedBy')} a JOIN {_pred('placedBy')} b ON a.o = b.o "
            f"WHERE a.s IN (SELECT s FROM {_pred('status')} WHERE o = 'F') "
            f"AND b.s IN (SELECT s FROM {_pred('status')} WHERE o = 'F')"
        ),
        "batch_sinks": (
            f"SELECT 'join_chain' AS query, * FROM ({_CHAIN_SQL}) "
            f"UNION ALL BY NAME SELECT 'star_const_single' AS query, * FROM ({_STAR_CONST_SINGLE_SQL})"
        ),
    }
    own = {k: w + v for k, v in q.items()}
    if corpus_queries:
        own |= corpus_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            own["pipeline"] = corpus_pipeline.ORACLE_SQL
    return own
