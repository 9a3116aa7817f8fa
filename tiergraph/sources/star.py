"""A star schema of customers, orders and line items as an annotation corpus.

A customer is a bundle, in the session of its nation. Levels: Customer (ITEM), Order (EVENT), Lineitem (SEGMENT), linked
downwards. A line item lasts its quantity in samples, one after another in order of its order's date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..plans.hierarchy import Hierarchy, Level
from . import store

HIERARCHY = Hierarchy(
    (Level("Customer", "ITEM", ("Customer", "Name")), Level("Order", "EVENT", ("Order", "Status")), Level("Lineitem", "SEGMENT", ("Lineitem", "LineStatus"))),
    (("Customer", "Order"), ("Order", "Lineitem")),
)
RATE = 1000.0
DB = "star"
#: Whole rows of lineitem are unique; their keys aren't.
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build(spark: SparkSession, sf_dir: str) -> Corpus:
    """The tables of a star schema below sf_dir as a corpus, without storing it."""
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    customer = _read(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    bundle = customer.select(F.col("c_custkey").alias("key"), F.lit(DB).alias("db_uuid"), F.col("n_name").alias("session"), F.col("c_custkey").cast("string").alias("bundle"), "c_mktsegment", "c_name", "c_acctbal", "n_regionkey")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    orders = orders.join(bundle.select("key", "db_uuid", "session", "bundle"), F.col("o_custkey") == F.col("key"))
    in_bundle = W.partitionBy("key")
    orders = orders.withColumn("seq_idx", F.row_number().over(in_bundle.orderBy("o_orderdate", "o_orderkey"))).withColumn("item_id", 1_000_000_000 + F.col("o_orderkey"))
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", *ORDER)
    lines = lines.join(orders.select("key", "db_uuid", "session", "bundle", "o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    by_time = in_bundle.orderBy("o_orderdate", "l_orderkey", *ORDER)
    lines = (
        lines.withColumn("seq_idx", F.row_number().over(by_time))
        .withColumn("sample_dur", F.col("l_quantity").cast("bigint"))
        .withColumn("sample_start", F.sum("sample_dur").over(by_time.rowsBetween(W.unboundedPreceding, 0)) - F.col("sample_dur"))
        .withColumn("item_id", 2_000_000_000 + F.col("l_orderkey") * 100 + F.row_number().over(W.partitionBy("key", "l_orderkey").orderBy(*ORDER)))
    )
    none = F.lit(None).cast("bigint")

    def item(df: DataFrame, item_id, level: str, kind: str, seq, point=none, start=none, dur=none) -> DataFrame:
        return df.select("db_uuid", "session", "bundle", item_id.alias("item_id"), F.lit(level).alias("level"), F.lit(kind).alias("type"), seq.alias("seq_idx"), F.lit(RATE).alias("sample_rate"), point.alias("sample_point"), start.alias("sample_start"), dur.alias("sample_dur"))

    def label(df: DataFrame, item_id, columns: dict[str, str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(k).alias("label_idx"), F.lit(name).alias("name"), F.col(column).alias("label")) for k, (name, column) in enumerate(columns.items(), 1)])
        return df.select("db_uuid", "session", "bundle", item_id.alias("item_id"), F.explode(pairs).alias("x")).select("db_uuid", "session", "bundle", "item_id", "x.*")

    zero, own = F.lit(0).cast("bigint"), F.col("item_id")
    items = item(bundle, zero, "Customer", "ITEM", F.lit(1))
    items = items.unionByName(item(orders, own, "Order", "EVENT", F.col("seq_idx"), point=F.col("seq_idx").cast("bigint")))
    items = items.unionByName(item(lines, own, "Lineitem", "SEGMENT", F.col("seq_idx"), start=F.col("sample_start"), dur=F.col("sample_dur")))
    labels = label(bundle, zero, {"Customer": "c_mktsegment", "Name": "c_name"})
    labels = labels.unionByName(label(orders, own, {"Order": "o_orderpriority", "Status": "o_orderstatus"}))
    labels = labels.unionByName(label(lines, own, {"Lineitem": "l_returnflag", "LineStatus": "l_linestatus"}))
    keys = ["db_uuid", "session", "bundle"]
    links = orders.select(*keys, zero.alias("from_id"), F.col("item_id").alias("to_id"), F.lit(None).cast("string").alias("label"))
    links = links.unionByName(lines.select(*keys, (1_000_000_000 + F.col("l_orderkey")).alias("from_id"), F.col("item_id").alias("to_id"), F.lit(None).cast("string").alias("label")))
    bundles = bundle.select("db_uuid", "session", F.col("bundle").alias("name"), F.concat("bundle", F.lit(".wav")).alias("annotates"), F.lit(RATE).alias("sample_rate"), F.md5("c_name").alias("md5_annot_json"))
    # metadata: Segment on some bundles, over their session's, over the database's
    text = F.lit("character").alias("field_type")
    meta_bundle = bundle.where(F.col("c_acctbal") > 0).select(*keys, F.lit("Segment").alias("field_name"), F.col("c_mktsegment").alias("field_value"), text)
    meta_bundle = meta_bundle.unionByName(bundle.select(*keys, F.lit("Balance").alias("field_name"), F.floor("c_acctbal").cast("string").alias("field_value"), F.lit("integer").alias("field_type")))
    sessions = nation.select(F.lit(DB).alias("db_uuid"), F.col("n_name").alias("session"), "n_regionkey")
    meta_session = sessions.select("db_uuid", "session", F.lit("Segment").alias("field_name"), F.concat(F.lit("of "), "session").alias("field_value"), text)
    meta_session = meta_session.where("n_regionkey < 3").unionByName(sessions.select("db_uuid", "session", F.lit("Region").alias("field_name"), F.col("n_regionkey").cast("string").alias("field_value"), F.lit("integer").alias("field_type")))
    meta_database = spark.range(1).select(F.lit(DB).alias("db_uuid"), F.explode(F.array(*[F.struct(F.lit(k).alias("field_name"), F.lit(v).alias("field_value")) for k, v in (("Segment", "any"), ("Language", "none"))])).alias("x"))
    meta_database = meta_database.select("db_uuid", "x.field_name", "x.field_value", text)
    return Corpus.of(spark, HIERARCHY, bundles=bundles, items=items, labels=labels, links=links, meta_bundle=meta_bundle, meta_session=meta_session, meta_database=meta_database)


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus of sf_dir, stored once a session: positions are numbered when it is built, so queries can be pushed down
    to the stored tables."""
    return store.once(spark, f"star:{sf_dir}", lambda: build(spark, sf_dir))
