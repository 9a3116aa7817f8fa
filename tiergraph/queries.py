"""The registered queries over the reference tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import scalars
from .operators import annotate, drafts, metadata, quantify, simulate, summary, transcribe
from .sources import annot_json, star, tracks
from .streaming import sync

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The star schema as annotation tables, in SQL: what sources.star builds.
BASE = """
WITH cust AS (
    SELECT c_custkey AS key, n_name AS session, CAST(c_custkey AS VARCHAR) AS bundle, c_mktsegment, c_name, c_acctbal, n_regionkey
    FROM customer JOIN nation ON c_nationkey = n_nationkey
), ord AS (
    SELECT key, session, bundle, o_orderkey, o_orderdate, o_orderpriority, o_orderstatus, 1000000000 + o_orderkey AS item_id,
           row_number() OVER (PARTITION BY key ORDER BY o_orderdate, o_orderkey) AS seq_idx
    FROM orders JOIN cust ON o_custkey = key
), lin AS (
    SELECT key, session, bundle, l_orderkey, l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS sample_dur,
           row_number() OVER t AS seq_idx, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (t ROWS UNBOUNDED PRECEDING) AS BIGINT) - CAST(l_quantity AS BIGINT) AS sample_start,
           2000000000 + l_orderkey * 100 + row_number() OVER (PARTITION BY key, l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS item_id
    FROM lineitem JOIN ord ON l_orderkey = o_orderkey
    WINDOW t AS (PARTITION BY key ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax)
), items AS (
    SELECT session, bundle, CAST(0 AS BIGINT) AS item_id, 'Customer' AS level, 'ITEM' AS type, CAST(1 AS BIGINT) AS seq_idx, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e FROM cust
    UNION ALL SELECT session, bundle, item_id, 'Order', 'EVENT', seq_idx, seq_idx, seq_idx FROM ord
    UNION ALL SELECT session, bundle, item_id, 'Lineitem', 'SEGMENT', seq_idx, sample_start, sample_start + sample_dur FROM lin
), lab AS (
    SELECT session, bundle, CAST(0 AS BIGINT) AS item_id, 'Customer' AS name, c_mktsegment AS label FROM cust
    UNION ALL SELECT session, bundle, 0, 'Name', c_name FROM cust
    UNION ALL SELECT session, bundle, item_id, 'Order', o_orderpriority FROM ord
    UNION ALL SELECT session, bundle, item_id, 'Status', o_orderstatus FROM ord
    UNION ALL SELECT session, bundle, item_id, 'Lineitem', l_returnflag FROM lin
    UNION ALL SELECT session, bundle, item_id, 'LineStatus', l_linestatus FROM lin
), lnk AS (
    SELECT session, bundle, CAST(0 AS BIGINT) AS from_id, item_id AS to_id FROM ord
    UNION ALL SELECT session, bundle, 1000000000 + l_orderkey, item_id FROM lin
), own AS (
    SELECT i.*, l.label FROM items i LEFT JOIN lab l ON l.session = i.session AND l.bundle = i.bundle AND l.item_id = i.item_id AND l.name = i.level
), meta AS (
    SELECT session, bundle, field_name, field_value, row_number() OVER (PARTITION BY session, bundle, field_name ORDER BY priority) AS k, priority FROM (
        SELECT session, bundle, 'Segment' AS field_name, c_mktsegment AS field_value, 1 AS priority FROM cust WHERE c_acctbal > 0
        UNION ALL SELECT session, bundle, 'Balance', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), 1 FROM cust
        UNION ALL SELECT session, bundle, 'Segment', 'of ' || session, 2 FROM cust WHERE n_regionkey < 3
        UNION ALL SELECT session, bundle, 'Region', CAST(n_regionkey AS VARCHAR), 2 FROM cust
        UNION ALL SELECT session, bundle, 'Segment', 'any', 3 FROM cust
        UNION ALL SELECT session, bundle, 'Language', 'none', 3 FROM cust
    )
)
"""
ON = "{0}.session = {1}.session AND {0}.bundle = {1}.bundle"


def register(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


def plain(found: DataFrame) -> DataFrame:
    """The columns of results that queries are compared by."""
    return found.select("session", "bundle", "start_item_id", "end_item_id", "level", "attribute", "labels", F.col("start_item_seq_idx").cast("bigint").alias("seq"), "start", "end")


def _row(first: str, last: str | None = None, level: str | None = None, attribute: str | None = None, label: str | None = None) -> str:
    last = last or first
    return f"{first}.session, {first}.bundle, {first}.item_id AS start_item_id, {last}.item_id AS end_item_id, {level or first + '.level'} AS level, {attribute or first + '.level'} AS attribute, {label or first + '.label'} AS labels, {first}.seq_idx AS seq, CAST({first}.s AS DOUBLE) AS \"start\", CAST({last}.e AS DOUBLE) AS \"end\""


def _simple(level: str, attribute: str, test: str) -> str:
    return f"SELECT {_row('i', attribute=chr(39) + attribute + chr(39), label='l.label')} FROM items i JOIN lab l ON {ON.format('i', 'l')} AND l.item_id = i.item_id WHERE i.level = '{level}' AND l.name = '{attribute}' AND {test}"


def _child(found: str) -> str:
    """Children of Order with their rank, filtered by found."""
    ranked = f"SELECT c.*, k.from_id, row_number() OVER (PARTITION BY c.session, c.bundle, k.from_id ORDER BY c.seq_idx) AS r, count(*) OVER (PARTITION BY c.session, c.bundle, k.from_id) AS n FROM own c JOIN lnk k ON {ON.format('c', 'k')} AND k.to_id = c.item_id WHERE c.level = 'Lineitem'"
    return f"SELECT DISTINCT {_row('x')} FROM ({ranked}) x WHERE {found}"


def _count(found: str) -> str:
    counted = f"SELECT p.*, (SELECT count(*) FROM lnk k WHERE {ON.format('k', 'p')} AND k.from_id = p.item_id) AS n FROM own p WHERE p.level = 'Order'"
    return f"SELECT {_row('x')} FROM ({counted}) x WHERE {found}"


PAIR = f"own a JOIN own b ON {ON.format('a', 'b')} AND a.level = 'Lineitem' AND b.level = 'Lineitem' AND b.seq_idx = a.seq_idx + 1"
HOP1 = f"own o JOIN lnk k ON {ON.format('o', 'k')} AND k.from_id = o.item_id JOIN own c ON {ON.format('k', 'c')} AND c.item_id = k.to_id"
HOP2 = f"own u JOIN lnk j ON {ON.format('u', 'j')} AND j.from_id = u.item_id JOIN own o ON {ON.format('j', 'o')} AND o.item_id = j.to_id JOIN lnk k ON {ON.format('o', 'k')} AND k.from_id = o.item_id JOIN own c ON {ON.format('k', 'c')} AND c.item_id = k.to_id"
SPAN = _row("a", "b", label="a.label || '->' || b.label")

EQL = {
    "eql_eq": ("Lineitem == R", _simple("Lineitem", "Lineitem", "l.label = 'R'")),
    "eql_neq": ("Order != 1-URGENT", _simple("Order", "Order", "l.label != '1-URGENT'")),
    "eql_glob": ("Customer =~ B.*I", _simple("Customer", "Customer", "regexp_matches(l.label, 'B..*I')")),
    "eql_nglob": ("Customer !~ [AM]", _simple("Customer", "Customer", "NOT regexp_matches(l.label, '[AM]')")),
    "eql_attribute": ("Lineitem:LineStatus == F", _simple("Lineitem", "LineStatus", "l.label = 'F'")),
    "eql_seq_span": ("[Lineitem == A -> Lineitem == R]", f"SELECT {SPAN} FROM {PAIR} WHERE a.label = 'A' AND b.label = 'R'"),
    "eql_seq_left": ("[#Lineitem == A -> Lineitem == R]", f"SELECT {_row('a')} FROM {PAIR} WHERE a.label = 'A' AND b.label = 'R'"),
    "eql_seq_right": ("[Lineitem == A -> #Lineitem == R]", f"SELECT {_row('b')} FROM {PAIR} WHERE a.label = 'A' AND b.label = 'R'"),
    "eql_dom_parent": ("[Order == 1-URGENT ^ Lineitem == R]", f"SELECT DISTINCT {_row('o')} FROM {HOP1} WHERE o.level = 'Order' AND o.label = '1-URGENT' AND c.label = 'R'"),
    "eql_dom_child": ("[Order == 1-URGENT ^ #Lineitem == R]", f"SELECT DISTINCT {_row('c')} FROM {HOP1} WHERE o.level = 'Order' AND o.label = '1-URGENT' AND c.label = 'R'"),
    "eql_dom_2hop": ("[Customer == BUILDING ^ Lineitem == R]", f"SELECT DISTINCT {_row('u')} FROM {HOP2} WHERE u.label = 'BUILDING' AND c.label = 'R'"),
    "eql_and": ("[Lineitem == R & Lineitem:LineStatus == F]", _simple("Lineitem", "Lineitem", "l.label = 'R' AND (i.session, i.bundle, i.item_id) IN (SELECT (session, bundle, item_id) FROM lab WHERE name = 'LineStatus' AND label = 'F')")),
    "eql_or": ("[Order == 1-URGENT | Lineitem == R]", f"{_simple('Order', 'Order', chr(39).join(('l.label = ', '1-URGENT', '')))} UNION {_simple('Lineitem', 'Lineitem', chr(39).join(('l.label = ', 'R', '')))}"),
    "eql_nested": (
        "[[Lineitem == A -> Lineitem == R] ^ Order == 1-URGENT]",
        f"SELECT DISTINCT {SPAN} FROM {PAIR} JOIN lnk k ON {ON.format('k', 'a')} AND k.to_id = a.item_id JOIN own o ON {ON.format('k', 'o')} AND o.item_id = k.from_id WHERE a.label = 'A' AND b.label = 'R' AND o.label = '1-URGENT'",
    ),
    "eql_start": ("Start(Order, Lineitem) == 1", _child("r = 1")),
    "eql_end": ("End(Order, Lineitem) == 1", _child("r = n")),
    "eql_medial": ("Medial(Order, Lineitem) == 1", _child("r > 1 AND r < n")),
    "eql_medial_n": ("Medial(Order, Lineitem, 2)", _child("r = 2")),
    "eql_start_not": ("Start(Order, Lineitem) != 1", _child("r != 1")),
    "eql_num_ge": ("Num(Order, Lineitem) >= 5", _count("n >= 5")),
    "eql_num_zero": ("Num(Order, Lineitem) == 0", _count("n = 0")),
}


def _eql(text: str):
    return lambda spark, sf_dir: plain(star.corpus(spark, sf_dir).query(text))


for _name, (_text, _sql) in EQL.items():
    register(_name, BASE + _sql)(_eql(_text))


def _found(spark: SparkSession, sf_dir: str, text: str = "Lineitem == R"):
    corpus = star.corpus(spark, sf_dir)
    return corpus, corpus.query(text)


NEXT = f"own a JOIN own b ON {ON.format('a', 'b')} AND a.level = b.level AND a.level = 'Lineitem' AND a.label = 'R'"


@register("nav_scout1", f"{BASE} SELECT {_row('b')} FROM {NEXT} AND b.seq_idx = a.seq_idx + 1")
def nav_scout1(spark, sf_dir):
    corpus, found = _found(spark, sf_dir)
    return plain(corpus.scout(found, 1))


@register("nav_scout_end", f"{BASE} SELECT {_row('c')} FROM {PAIR} JOIN own c ON {ON.format('c', 'b')} AND c.level = 'Lineitem' AND c.seq_idx = b.seq_idx + 1 WHERE a.label = 'A' AND b.label = 'R'")
def nav_scout_end(spark, sf_dir):
    corpus, found = _found(spark, sf_dir, "[Lineitem == A -> Lineitem == R]")
    return plain(corpus.scout(found, 1, count_from="END"))


@register(
    "nav_scout_capture2",
    f"""{BASE} SELECT a.session, a.bundle, b.item_id AS start_item_id, coalesce(c.item_id, b.item_id) AS end_item_id, 'Lineitem' AS level, 'Lineitem' AS attribute,
    b.label || coalesce(' ' || c.label, '') AS labels, b.seq_idx AS seq, CAST(b.s AS DOUBLE) AS "start", CAST(coalesce(c.e, b.e) AS DOUBLE) AS "end"
    FROM {NEXT} AND b.seq_idx = a.seq_idx + 1 LEFT JOIN own c ON {ON.format("c", "b")} AND c.level = 'Lineitem' AND c.seq_idx = b.seq_idx + 1""",
)
def nav_scout_capture2(spark, sf_dir):
    corpus, found = _found(spark, sf_dir)
    return plain(corpus.scout(found, 1, capture=2))


@register(
    "nav_scout_cross_bundle",
    f"""{BASE} SELECT session, bundle, item_id AS start_item_id, item_id AS end_item_id, level, level AS attribute, label AS labels, seq_idx AS seq, CAST(s AS DOUBLE) AS "start", CAST(e AS DOUBLE) AS "end" FROM (
        SELECT b.*, row_number() OVER (PARTITION BY a.session, a.bundle, a.item_id ORDER BY b.bundle) AS k
        FROM own a JOIN own b ON a.session = b.session AND a.level = 'Order' AND b.level = 'Order' AND a.label = '1-URGENT' AND b.seq_idx = a.seq_idx + 12) WHERE k = 1""",
)
def nav_scout_cross_bundle(spark, sf_dir):
    corpus, found = _found(spark, sf_dir, "Order == 1-URGENT")
    return plain(corpus.scout(found, 12, across_bundles=True))


@register("nav_retreat", f"{BASE} SELECT {_row('b')} FROM {NEXT} AND b.seq_idx = a.seq_idx - 1")
def nav_retreat(spark, sf_dir):
    corpus, found = _found(spark, sf_dir)
    return plain(corpus.retreat(found, 1))


@register("nav_ascend", f"{BASE} SELECT DISTINCT {_row('u')} FROM {HOP2} WHERE u.level = 'Customer' AND c.label = 'R'")
def nav_ascend(spark, sf_dir):
    corpus, found = _found(spark, sf_dir)
    return plain(corpus.ascend_to(found, "Customer"))


@register("nav_descend", f"{BASE} SELECT DISTINCT {_row('c')} FROM {HOP1} WHERE o.level = 'Order' AND o.label = '1-URGENT'")
def nav_descend(spark, sf_dir):
    corpus, found = _found(spark, sf_dir, "Order == 1-URGENT")
    return plain(corpus.descend_to(found, "Lineitem"))


@register("meta_inherit_long", f"{BASE} SELECT session, bundle, field_name, field_value FROM meta WHERE k = 1")
def meta_inherit_long(spark, sf_dir):
    return metadata.long(star.corpus(spark, sf_dir)).drop("db_uuid", "field_type")


WIDE = "SELECT session, bundle, " + ", ".join(f"max(CASE WHEN field_name = '{f}' THEN field_value END) AS \"{f}\"" for f in ("Balance", "Language", "Region", "Segment")) + " FROM meta WHERE k = 1"


@register("meta_inherit_wide", f"{BASE} {WIDE} GROUP BY session, bundle")
def meta_inherit_wide(spark, sf_dir):
    return star.corpus(spark, sf_dir).metadata().drop("db_uuid")


@register("meta_regex_subset", f"{BASE} {WIDE} AND regexp_matches(session, '_1') AND regexp_matches(bundle, '7$') GROUP BY session, bundle")
def meta_regex_subset(spark, sf_dir):
    return star.corpus(spark, sf_dir)["_1", "7$"].drop("db_uuid")


@register("meta_field_coalesce", f"{BASE} SELECT session, bundle, CAST(max(CASE WHEN field_name = 'Balance' THEN field_value END) AS BIGINT) AS value FROM meta WHERE k = 1 GROUP BY session, bundle")
def meta_field_coalesce(spark, sf_dir):
    return metadata.field(star.corpus(spark, sf_dir), "Balance", "integer").drop("db_uuid")


@register(
    "meta_diagnostics",
    f"""{BASE}, sess AS (SELECT n_name AS session, n_regionkey FROM nation)
    SELECT 'Segment' AS field_name, (SELECT count(*) FROM cust WHERE c_acctbal > 0) AS n_bundles, (SELECT count(*) FROM sess WHERE n_regionkey < 3) AS n_sessions, CAST(1 AS BIGINT) AS n_databases, 'bundle+session+database' AS levels
    UNION ALL SELECT 'Balance', (SELECT count(*) FROM cust), 0, 0, 'bundle' UNION ALL SELECT 'Region', 0, (SELECT count(*) FROM sess), 0, 'session' UNION ALL SELECT 'Language', 0, 0, 1, 'database'""",
)
def meta_diagnostics(spark, sf_dir):
    return metadata.diagnostics(star.corpus(spark, sf_dir))


@register("biographize", f"{BASE}, w AS ({WIDE} GROUP BY session, bundle) SELECT i.session, i.bundle, i.item_id AS start_item_id, i.label AS labels, w.\"Region\", w.\"Segment\" FROM own i LEFT JOIN w ON {ON.format('i', 'w')} WHERE i.level = 'Lineitem' AND i.label = 'R'")
def biographize(spark, sf_dir):
    corpus, found = _found(spark, sf_dir)
    return metadata.biographize(corpus, found.select("db_uuid", "session", "bundle", "start_item_id", "labels"), ["Region", "Segment"]).drop("db_uuid")


def _two_databases(spark, sf_dir):
    """The corpus twice, the second time under another name and with values of its own."""
    first = star.corpus(spark, sf_dir)
    tables = {}
    for name in ("bundles", "items", "labels", "links", "meta_bundle", "meta_session", "meta_database"):
        table = getattr(first, name)
        again = table.withColumn("db_uuid", F.lit("other"))
        if name.startswith("meta_"):
            again = again.withColumn("field_value", F.concat(F.lit("other "), "field_value"))
        tables[name] = table.unionByName(again)
    return first.replace(**tables)


@register(
    "meta_two_databases",
    f"""{BASE}, w AS (SELECT session, bundle, max(CASE WHEN field_name = 'Region' THEN field_value END) AS "Region", max(CASE WHEN field_name = 'Segment' THEN field_value END) AS "Segment" FROM meta WHERE k = 1 GROUP BY session, bundle), d AS (SELECT 'star' AS db_uuid, '' AS pre UNION ALL SELECT 'other', 'other ')
    SELECT d.db_uuid, i.session, i.bundle, i.item_id AS start_item_id, d.pre || w."Region" AS "Region", d.pre || w."Segment" AS "Segment" FROM own i JOIN w ON {ON.format('i', 'w')} CROSS JOIN d WHERE i.level = 'Customer' AND i.label = 'BUILDING'""",
)
def meta_two_databases(spark, sf_dir):
    corpus = _two_databases(spark, sf_dir)
    found = corpus.query("Customer == BUILDING").select("db_uuid", "session", "bundle", "start_item_id")
    return metadata.biographize(corpus, found, ["Region", "Segment"])



R_ITEMS = "own WHERE level = 'Lineitem' AND label = 'R'"


@register(
    "seg_summary",
    f"""{BASE} SELECT count(*) AS n, count(DISTINCT label) AS n_labels, count(DISTINCT session) AS n_sessions, count(DISTINCT session || '/' || bundle) AS n_bundles, CAST(min(e - s) AS DOUBLE) AS min_ms, CAST(max(e - s) AS DOUBLE) AS max_ms,
    round(avg(e - s), 6) AS mean_ms, quantile_cont(CAST(e - s AS DOUBLE), 0.5) AS median_ms, CAST(sum(e - s) AS DOUBLE) AS total_ms FROM {R_ITEMS}""",
)
def seg_summary(spark, sf_dir):
    whole = summary.segment_stats(_found(spark, sf_dir)[1])
    # sums of samples over a rate are whole milliseconds here
    return whole.withColumns({c: F.round(c, 6) for c in ("min_ms", "max_ms", "median_ms", "total_ms")})


@register("seg_label_topk", f"{BASE} SELECT label AS labels, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM own WHERE level = 'Order'), 6) AS percent FROM own WHERE level = 'Order' GROUP BY label ORDER BY n DESC, label LIMIT 3")
def seg_label_topk(spark, sf_dir):
    return summary.top_labels(_found(spark, sf_dir, "Order =~ *")[1], 3)


@register("seg_session_stats", f"{BASE} SELECT count(*) AS sessions, round(avg(n), 6) AS mean_n, min(n) AS min_n, max(n) AS max_n FROM (SELECT session, count(*) AS n FROM {R_ITEMS} GROUP BY session)")
def seg_session_stats(spark, sf_dir):
    return summary.per_session(_found(spark, sf_dir)[1])


@register("corpus_counts", f"{BASE} SELECT 'bundles' AS what, count(*) AS n FROM cust UNION ALL SELECT 'items', count(*) FROM items UNION ALL SELECT 'labels', count(*) FROM lab UNION ALL SELECT 'links', count(*) FROM lnk UNION ALL SELECT 'sessions', count(DISTINCT session) FROM cust")
def corpus_counts(spark, sf_dir):
    return summary.corpus_counts(star.corpus(spark, sf_dir))


@register("level_counts", f"{BASE} SELECT level, type, count(*) AS n_items, count(DISTINCT session || '/' || bundle) AS n_bundles FROM items GROUP BY level, type")
def level_counts(spark, sf_dir):
    return summary.level_counts(star.corpus(spark, sf_dir))


@register("seg_union_fill", f"{BASE} SELECT session, bundle, item_id AS start_item_id, CAST(e - s AS DOUBLE) AS duration, CAST(NULL AS VARCHAR) AS note FROM {R_ITEMS} UNION ALL SELECT session, bundle, item_id, NULL, label FROM own WHERE level = 'Customer'")
def seg_union_fill(spark, sf_dir):
    corpus, found = _found(spark, sf_dir)
    a = found.select("session", "bundle", "start_item_id", (F.col("sample_end") - F.col("sample_start")).cast("double").alias("duration"))
    b = corpus.query("Customer =~ *").select("session", "bundle", "start_item_id", F.col("labels").alias("note"))
    return a.unionByName(b, allowMissingColumns=True)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("psy_st_erb", "SELECT p_partkey, round(12 * log2(p_retailprice / 16.35160), 6) AS st, round(11.17 * ln((p_retailprice + 0.312) / (p_retailprice + 14.675)) + 43, 6) AS erb FROM part")
def psy_st_erb(spark, sf_dir):
    f = F.col("p_retailprice")
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(scalars.semitones(f), 6).alias("st"), F.round(scalars.erb_rate(f), 6).alias("erb"))


@register(
    "fmt_bytes",
    """SELECT p_partkey, b, CASE WHEN b < 1024 THEN printf('%.2f B', CAST(b AS DOUBLE)) WHEN b < 1048576 THEN printf('%.2f KB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576.0) ELSE printf('%.2f GB', b / 1073741824.0) END AS size,
    printf('%02d:%02d:%02d', b // 3600, b % 3600 // 60, b % 60) AS duration FROM (SELECT p_partkey, 500 + p_partkey * p_size * 37 AS b FROM part)""",
)
def fmt_bytes(spark, sf_dir):
    b = (500 + F.col("p_partkey") * F.col("p_size") * 37).alias("b")
    return _table(spark, sf_dir, "part").select("p_partkey", b).select("p_partkey", "b", scalars.format_bytes(F.col("b")).alias("size"), scalars.format_duration(F.col("b")).alias("duration"))


@register("dsp_params", "SELECT c_custkey, CAST(CASE WHEN c_custkey % 90 < 12 THEN 1000 WHEN c_mktsegment = 'BUILDING' THEN 500 WHEN c_mktsegment = 'MACHINERY' THEN 560 ELSE 530 END AS DOUBLE) AS nominalF1, CAST(10 * (CASE WHEN c_custkey % 90 < 12 THEN 1000 WHEN c_mktsegment = 'BUILDING' THEN 500 WHEN c_mktsegment = 'MACHINERY' THEN 560 ELSE 530 END) AS DOUBLE) AS maxFormantHz FROM customer")
def dsp_params(spark, sf_dir):
    gender = F.when(F.col("c_mktsegment") == "BUILDING", "Male").when(F.col("c_mktsegment") == "MACHINERY", "Female").otherwise("Unknown")
    rows = _table(spark, sf_dir, "customer").select("c_custkey", gender.alias("Gender"), (F.col("c_custkey") % 90).cast("string").alias("Age"))
    return quantify.derive_parameters(rows, ["Gender", "Age"]).drop("Gender", "Age")


@register("quantify_at", "SELECT vec_id, t AS time_point, round(CAST(embedding[greatest(1, least(len(embedding), CAST(round_even(t * len(embedding), 0) AS INT)))] AS DOUBLE), 6) AS frame FROM embeddings, (VALUES (CAST(0.25 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.75 AS DOUBLE))) v(t)")
def quantify_at(spark, sf_dir):
    rows = quantify.resample(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", [0.25, 0.5, 0.75])
    return rows.select("vec_id", "time_point", F.round(F.col("frame").cast("double"), 6).alias("frame"))


@register("quantify_udf", f"{BASE} SELECT session, bundle, item_id AS start_item_id, CAST(e - s AS DOUBLE) AS ms, CAST((s + e) AS DOUBLE) / 2 AS mid FROM {R_ITEMS}")
def quantify_udf(spark, sf_dir):
    found = _found(spark, sf_dir)[1].select("session", "bundle", "start_item_id", "start", "end")
    out = quantify.quantify(found, lambda seg: {"ms": seg["end"] - seg["start"], "mid": (seg["start"] + seg["end"]) / 2}, "ms double, mid double", columns=["session", "bundle", "start_item_id", "start", "end"])
    return out.select("session", "bundle", "start_item_id", F.round("ms", 6).alias("ms"), F.round("mid", 6).alias("mid"))


@register("quantify_pairs", f"{BASE} SELECT session, count(*) FILTER (level = 'Lineitem' AND label = 'R') AS n_x, count(*) FILTER (level = 'Order' AND label = '1-URGENT') AS n_y FROM own GROUP BY session HAVING n_x > 0 AND n_y > 0")
def quantify_pairs(spark, sf_dir):
    corpus, found = _found(spark, sf_dir)
    x, y = (df.select("session", "start_item_id") for df in (found, corpus.query("Order == 1-URGENT")))
    return quantify.quantify_pairs(x, y, lambda a, b: pd.DataFrame({"session": a["session"][:1], "n_x": [len(a)], "n_y": [len(b)]}), "session string, n_x bigint, n_y bigint")


@register("param_grid", "SELECT CAST(a + 3 * b + 1 AS INT) AS param_id, CAST([500, 600, 700][a + 1] AS BIGINT) AS f1, CAST([16000, 22050][b + 1] AS BIGINT) AS rate FROM range(3) x(a), range(2) y(b)")
def param_grid(spark, sf_dir):
    grid = simulate.parameter_grid(spark, {"f1": [500, 600, 700]}, {"rate": [16000, 22050]})
    return grid.select("param_id", F.get_json_object("dsp", "$.f1").cast("bigint").alias("f1"), F.get_json_object("prep", "$.rate").cast("bigint").alias("rate"))


@register("simulate_crossjoin", f"{BASE} SELECT session, bundle, item_id AS start_item_id, CAST(p AS INT) AS param_id, CAST((e - s) * p AS DOUBLE) AS value FROM own, range(1, 4) g(p) WHERE level = 'Lineitem' AND label = 'R'")
def simulate_crossjoin(spark, sf_dir):
    found = _found(spark, sf_dir)[1].select("session", "bundle", "start_item_id", "start", "end")
    grid = simulate.parameter_grid(spark, {"k": [1, 2, 3]})
    out = simulate.quantify_grid(found, grid, lambda seg, k: {"value": (seg["end"] - seg["start"]) * k}, "value double")
    return out.select("session", "bundle", "start_item_id", "param_id", F.round("value", 6).alias("value"))


@register("assess_rmse", "SELECT CAST(p AS INT) AS param_id, count(*) AS n, round(sqrt(avg(power(value * p - 100, 2))), 6) AS rmse FROM events, range(1, 4) g(p) WHERE value IS NOT NULL GROUP BY p")
def assess_rmse(spark, sf_dir):
    events = _table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", "value")
    grid = simulate.parameter_grid(spark, {"k": [1, 2, 3]}).select("param_id", F.get_json_object("dsp", "$.k").cast("int").alias("k"))
    simulated = events.crossJoin(F.broadcast(grid)).select("param_id", "event_id", (F.col("value") * F.col("k")).alias("x"))
    return simulate.assess_error(simulated, events.select("event_id", F.lit(100.0).alias("x")), ["event_id"], "x")


def _suggested(spark: SparkSession, sf_dir: str):
    """Events as suggested segments of customers: one a second after another, some too long, some short."""
    corpus = star.corpus(spark, sf_dir)
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    k = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    rows = events.withColumn("k", k).join(corpus.bundles.select("db_uuid", "session", F.col("name").alias("bundle")), F.col("user_id").cast("string") == F.col("bundle"))
    rows = rows.select("db_uuid", "session", "bundle", (10.0 * F.col("k")).alias("start_time"), (10.0 * F.col("k") + F.col("event_id") % 13).alias("end_time"), F.col("event_type").alias("label"))
    return transcribe.prepare(corpus, "Event", "SEGMENT"), transcribe.suggestions(rows, "Event")


SUGGESTED = """, sug AS (
    SELECT session, bundle, CAST(10 * k AS DOUBLE) AS start_time, CAST(10 * k + event_id % 13 AS DOUBLE) AS end_time, event_type AS label, k
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) JOIN cust ON user_id = key
), ends AS (SELECT session, bundle, max(e) AS ms, max(item_id) AS last_id FROM items GROUP BY session, bundle)"""


@register(
    "sugg_problems",
    f"""{BASE}{SUGGESTED}, x AS (SELECT s.*, lead(start_time) OVER (PARTITION BY s.session, s.bundle ORDER BY start_time, end_time) AS next_start, ms FROM sug s LEFT JOIN ends ON {ON.format("s", "ends")})
    SELECT session, bundle, start_time, end_time, label, 'overlap' AS problem FROM x WHERE end_time > next_start
    UNION ALL SELECT session, bundle, start_time, end_time, label, 'outside' FROM x WHERE end_time > ms UNION ALL SELECT session, bundle, start_time, end_time, label, 'short' FROM x WHERE end_time - start_time < 5""",
)
def sugg_problems(spark, sf_dir):
    return transcribe.problems(*_suggested(spark, sf_dir), min_ms=5.0).select("session", "bundle", "start_time", "end_time", "label", "problem")


@register("transcribe_numbering", f"{BASE}{SUGGESTED} SELECT s.session, s.bundle, last_id + k AS item_id, CAST(k AS INT) AS seq_idx, CAST(start_time AS BIGINT) AS sample_start, CAST(end_time - start_time AS BIGINT) AS sample_dur, label FROM sug s JOIN ends ON {ON.format('s', 'ends')}")
def transcribe_numbering(spark, sf_dir):
    items, labels = transcribe.numbered(*_suggested(spark, sf_dir))
    return items.join(labels, ["db_uuid", "session", "bundle", "item_id"]).select("session", "bundle", "item_id", "seq_idx", "sample_start", "sample_dur", "label")


@register("draft_resume", f"{BASE} SELECT session, bundle FROM cust WHERE c_mktsegment != 'BUILDING'")
def draft_resume(spark, sf_dir):
    corpus, found = _found(spark, sf_dir, "Customer == BUILDING")
    done = found.select("session", "bundle", F.lit(None).cast("string").alias("error"))
    return drafts.pending(corpus.bundles.select("session", F.col("name").alias("bundle")), done)


@register("asof_pitch", "SELECT a.event_id, a.user_id, b.value AS pitch FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_pitch(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    left = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("pitch"))
    return quantify.asof(left, right, ["user_id"], "ts", "at", ["pitch"]).drop("ts")


@register("diff_stats", f"""{BASE} SELECT session, bundle, count(d) AS n, round(stddev_samp(d), 6) AS sd, round(avg(d), 6) AS mean, round(quantile_cont(CAST(d AS DOUBLE), 0.5), 6) AS median, round(stddev_pop(d) / avg(d), 6) AS cv
    FROM (SELECT session, bundle, sample_start - lag(sample_start) OVER (PARTITION BY session, bundle ORDER BY seq_idx) AS d FROM lin) GROUP BY session, bundle HAVING count(d) > 1""")
def diff_stats(spark, sf_dir):
    items = star.corpus(spark, sf_dir).items.where("level = 'Lineitem'").select("session", "bundle", "seq_idx", "sample_start")
    return quantify.difference_stats(items, ["session", "bundle"], ["seq_idx"], "sample_start").where("n > 1")


@register("change_detect", "SELECT doc_id, md5(text) AS digest, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'changed' END AS change FROM documents WHERE doc_id % 3 < 2")
def change_detect(spark, sf_dir):
    now = _table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    before = now.where("doc_id % 3 > 0").withColumn("digest", F.when(F.col("doc_id") % 3 == 1, F.lit("other")).otherwise(F.col("digest")))
    return sync.changes(now, before, ["doc_id"], "digest")


@register("signal_hash", "SELECT doc_id, to_json([{'name': 'lang', 'sha1': sha1(lang)}, {'name': 'text', 'sha1': sha1(text)}]) AS hashes FROM documents")
def signal_hash(spark, sf_dir):
    """Digests of a bundle's files as a JSON list: a document is a bundle of two."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("content")) for c in ("lang", "text")])).alias("x"))
    return annot_json.file_digests(docs.select("doc_id", "x.*"), ["doc_id"], ["name"]).withColumnRenamed("field_value", "hashes")


@register("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>")["k"].cast("bigint").alias("k"))


@register("cache_summary", "SELECT event_type AS format, count(*) AS n, sum(event_id) AS bytes, min(ts) AS oldest, max(ts) AS newest FROM events GROUP BY event_type")
def cache_summary(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return drafts.cache_summary(events.select(F.col("event_type").alias("format"), F.col("event_id").alias("size_bytes"), F.col("ts").alias("created_at"))).withColumn("bytes", F.col("bytes").cast("decimal(38,0)"))


@register("latest_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_wins(spark, sf_dir):
    return drafts.latest(_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts").drop("ts")


@register("pitch_tones")
def pitch_tones(spark, sf_dir):
    """Tones of a contour made from each embedding; rows only, as SQL can't say it."""
    from .functions.prosody import intsint

    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x * 40 + 180).cast("double")).alias("f0"))
    return rows.select("vec_id", intsint("f0").alias("x")).select("vec_id", F.size("x.targets").alias("n"), F.round("x.range", 3).alias("span"), F.round("x.key", 3).alias("key"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as tracks of a frame each 10 ms."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("session"), F.posexplode("embedding").alias("at", "x"))
    return rows.select("session", F.lit("b").alias("bundle"), F.lit("e").alias("extension"), F.lit("x").alias("field"), (F.col("at") + 1).cast("bigint").alias("frame"), (F.col("at") * 10.0).alias("t"), F.array(F.col("x").cast("double")).alias("values"))


@register("track_between", "SELECT vec_id, i AS frame, round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE (i - 1) * 10 BETWEEN 50 AND 120")
def track_between(spark, sf_dir):
    found = tracks.between(_frames(spark, sf_dir), 50, 120, "x")
    return found.select(F.col("session").cast("bigint").alias("vec_id"), "frame", F.round(F.get("values", F.lit(0)), 6).alias("value"))


@register("track_segments", f"{BASE}{SUGGESTED} SELECT o.session, o.bundle, o.item_id AS start_item_id, CAST(s.k AS BIGINT) AS frame FROM own o JOIN sug s ON {ON.format('o', 's')} WHERE o.level = 'Lineitem' AND o.label = 'R' AND s.start_time BETWEEN o.s AND o.e")
def track_segments(spark, sf_dir):
    """Segments with the events of their bundle, one each 10 ms, that lie in them."""
    corpus, found = _found(spark, sf_dir)
    _, events = _suggested(spark, sf_dir)
    at = events.select("session", "bundle", (F.col("start_time") / 10).cast("bigint").alias("frame"), F.col("start_time").alias("t"))
    return tracks.of_segments(found, at, ["session", "bundle", "start_item_id"]).drop("t")


@register("signal_present", f"{BASE}, c AS (SELECT DISTINCT session, bundle FROM cust JOIN events ON user_id = key WHERE event_type = 'click') SELECT o.session, o.bundle, o.item_id AS start_item_id FROM own o JOIN c ON {ON.format('o', 'c')} WHERE o.level = 'Lineitem' AND o.label = 'R'")
def signal_present(spark, sf_dir):
    corpus, found = _found(spark, sf_dir)
    events = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("extension"))
    files = corpus.bundles.join(events, "name").select("session", F.col("name").alias("bundle"), "extension")
    return tracks.with_signal(found, files, "click").select("session", "bundle", "start_item_id")


@register(
    "sample_window",
    """SELECT p_partkey, first, first + 2 AS last FROM (SELECT p_partkey, CAST(least(greatest(round_even(p_size + (p_partkey % 11) / CAST(10 AS DOUBLE) * (p_partkey % 50) - CAST(1.5 AS DOUBLE), 0), p_size), p_size + 28) AS BIGINT) AS first FROM part)""",
)
def sample_window(spark, sf_dir):
    start, long = F.col("p_size"), F.col("p_partkey") % 50
    found = tracks.sample_window(start, start + long, F.col("p_partkey") % 11 / F.lit(10.0), F.lit(3), start + 30)
    return _table(spark, sf_dir, "part").select("p_partkey", found.alias("x")).select("p_partkey", "x.*")


@register("corpus_glimpse", f"{BASE} SELECT level, type, count(*) AS n_items, count(DISTINCT label) AS n_labels, array_to_string(list_slice(list_sort(list(DISTINCT label)), 1, 3), ',') AS examples FROM own GROUP BY level, type")
def corpus_glimpse(spark, sf_dir):
    return summary.glimpse(star.corpus(spark, sf_dir), 3).drop("db_uuid").withColumn("examples", F.array_join("examples", ","))


@register(
    "tone_summary",
    """WITH j AS (SELECT a.user_id, a.ts, CAST(a.event_id % 3 AS VARCHAR) AS tone, round(b.value) AS v FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts),
    d AS (SELECT *, v - lag(v) OVER (PARTITION BY user_id ORDER BY ts, tone) AS d FROM j WHERE v IS NOT NULL), n AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS seconds FROM events GROUP BY user_id)
    SELECT d.user_id, round(stddev_samp(d), 6) AS v_diff_stdev, round(avg(d), 6) AS v_diff_mean, round(quantile_cont(d, 0.5), 6) AS v_diff_median, count(*) AS n_tones, count(DISTINCT tone) AS n_different, any_value(seconds) AS seconds, round(count(*) / any_value(seconds), 6) AS tones_per_second
    FROM d JOIN n ON d.user_id = n.user_id GROUP BY d.user_id""",
)
def tone_summary(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("ts").alias("t"), F.round("value").alias("v"))
    points = events.where("event_type = 'click'").select("user_id", "t", (F.col("event_id") % 3).cast("string").alias("tone"))
    measures = events.where("event_type = 'view'").select("user_id", "t", "v")
    seconds = events.groupBy("user_id").agg(F.count("*").cast("double").alias("seconds"))
    return annotate.tone_summary(points, measures, ["user_id"], ["v"], seconds).drop("v_diff_variation")


@register("annotate_batch", "SELECT vec_id, CAST((i - 1) * 10 AS DOUBLE) AS start_time, 'peak' AS label FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE CAST(embedding[i] AS DOUBLE) > 0.1")
def annotate_batch(spark, sf_dir):
    """An event at each value above a limit, by a Python annotator."""

    def peaks(row: dict, limit: float) -> pd.DataFrame:
        at = [k * 10.0 for k, x in enumerate(row["wave"]) if x > limit]
        return pd.DataFrame({"start_time": at, "end_time": at, "label": "peak"})

    files = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("wave"))
    return annotate.annotate(files, peaks, {"limit": 0.1}, ["vec_id"]).where("error IS NULL").select("vec_id", "start_time", "label")


@register(
    "seg_measures",
    f"{BASE} "
    + " UNION ALL ".join(f"SELECT '{name}' AS measure, count({x}) AS n, count(*) - count({x}) AS missing, CAST(min({x}) AS DOUBLE) AS \"min\", CAST(max({x}) AS DOUBLE) AS \"max\", round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS sd FROM own WHERE level != 'Order'" for name, x in (("sample_start", "s"), ("sample_end", "e"))),
)
def seg_measures(spark, sf_dir):
    corpus = star.corpus(spark, sf_dir)
    return summary.measure_stats(corpus.query("Customer =~ *").unionByName(corpus.query("Lineitem =~ *")), ["sample_start", "sample_end"])


@register("meta_set", f"{BASE} SELECT session, bundle, CASE WHEN bundle LIKE '%7' THEN 'set' ELSE max(CASE WHEN field_name = 'Segment' THEN field_value END) END AS \"Segment\" FROM meta WHERE k = 1 GROUP BY session, bundle")
def meta_set(spark, sf_dir):
    return star.corpus(spark, sf_dir).set_metadata(bundle="7$", Segment="set").metadata(fields=["Segment"]).drop("db_uuid")


@register("quantify_cached", f"{BASE} SELECT session, bundle, item_id AS start_item_id, CASE WHEN item_id % 2 = 0 THEN -1.0 ELSE CAST(e - s AS DOUBLE) END AS ms FROM {R_ITEMS}")
def quantify_cached(spark, sf_dir):
    _, found = _found(spark, sf_dir)
    keys = ["session", "bundle", "start_item_id"]
    cache = found.where("start_item_id % 2 = 0").select(*keys, F.lit(-1.0).alias("ms"))
    return quantify.quantify_cached(found.select(*keys, "start", "end"), cache, lambda rows: rows.select(*keys, F.round(F.col("end") - F.col("start"), 6).alias("ms")), keys)


@register("enrich_grid", "SELECT vec_id, CAST(k AS INT) AS param_id, CAST(k * len(embedding) AS DOUBLE) AS value FROM embeddings, range(1, 3) g(k)")
def enrich_grid(spark, sf_dir):
    files = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    grid = simulate.parameter_grid(spark, {"k": [1, 2]})
    made = simulate.enrich_grid(files, grid, lambda row, k: {"value": [float(k * len(row["embedding"]))]}, "value double")
    return made.select("vec_id", "param_id", F.get("track", F.lit(0))["value"].alias("value"))


@register("scalars_more", "SELECT p_partkey, round(log2(p_retailprice), 6) AS octave, round(power(2, p_size / CAST(10 AS DOUBLE)), 6) AS linear, CAST(floor(p_retailprice + 0.5) AS INT) AS rounded, greatest(least(p_retailprice, 1500.0), 1000.0) AS clipped, CAST(p_size * 1024 AS DOUBLE) AS bytes FROM part")
def scalars_more(spark, sf_dir):
    price, size = F.col("p_retailprice").cast("double"), F.col("p_size")
    return _table(spark, sf_dir, "part").select(
        "p_partkey", F.round(scalars.octave(price), 6).alias("octave"), F.round(scalars.linear(size / F.lit(10.0)), 6).alias("linear"), scalars.round_half_up(price).alias("rounded"),
        scalars.clip(price, 1000.0, 1500.0).alias("clipped"), scalars.parse_size(F.concat(size.cast("string"), F.lit(" kB"))).alias("bytes"),
    )
