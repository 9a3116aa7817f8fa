"""Exact deduplication by a stateful stream.

A store is a folder with the texts that ever arrived and the checkpoint of a stream over them. The stream keeps, for
each digest, the identifier and the content locator (file and row in the store) of the row that stays, and the number
of rows. That state lives on disk (RocksDB), never expires, and is carried from run to run: a text that arrives in a
later run is caught by what earlier runs left. Rows of one digest are combined before the shuffle, so a text with a
third of all copies costs one state row per task and batch.

On a hit the counterpart is read by its locator, and both texts are compared byte by byte.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_key, materialise, maybe_broadcast, remove, small, work_path

PROVIDER = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition sets megabytes aside
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Files of the store in one micro-batch, so that their number grows with the input.
BATCH_FILES = 1024
#: Copies of one text that are compared with one shipped copy of the representative.
COMPARE_ROWS = 512
BROADCAST_ROWS = 100_000


def _digest(text):
    return F.unhex(F.sha2(text, 256))


def _located(content: DataFrame, *columns: str) -> DataFrame:
    """Rows of the store with their locator."""
    return content.select(*columns, F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"))


def update_state(path: str, arrivals: DataFrame, scratch: Scratch) -> DataFrame:
    """Run what is new in the store at path through its state; (digest, doc_id, locator, n) of the whole state."""
    spark = arrivals.sparkSession
    before = {k: spark.conf.get(k, None) for k in PROVIDER}
    for k, v in PROVIDER.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", BATCH_FILES).parquet(f"{path}/content/*")
        keyed = _located(stream, "digest", "doc_id").groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("rep"), F.count("*").alias("n"))
        run = keyed.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        rows = spark.read.format("statestore").load(f"{path}/state")
        kept = rows.select("key.digest", F.col("value.max").alias("rep"), F.col("value.count").alias("n"))
        return scratch.keep(kept.select("digest", "rep.doc_id", "rep.locator", "n"), "dedup-kept")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def collisions(arrived: DataFrame, everything: DataFrame, kept: DataFrame) -> DataFrame:
    """(digest) of hits in which some arrived text differs in its bytes from that at the locator of the row that stays.

    Copies of a large group are spread over salts, and the text at the locator is sent to each salt.
    """
    groups = kept.where("n > 1").select("digest", F.col("locator").alias("at"), "n", F.ceil(F.col("n") / COMPARE_ROWS).cast("int").alias("parts"))
    few = small(groups, BROADCAST_ROWS)

    def hits(rows: DataFrame) -> DataFrame:
        # a few groups are broadcast whole; else groups with many copies alone are
        return rows.join(F.broadcast(groups), "digest") if few else by_key(rows, groups, "digest", kept)

    copies = hits(_located(arrived, "digest", "text")).where("locator != at").select("digest", "text", F.pmod(F.xxhash64("locator"), F.col("parts")).cast("int").alias("salt"))
    first = hits(_located(everything, "digest", "text")).where("locator = at")
    first = first.select("digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("text").alias("kept_text"))
    return copies.join(first, ["digest", "salt"]).where("text != kept_text").select("digest").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=_digest, store: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest identifier stays. Null text counts as empty; a null identifier is less
    than any other; of rows that repeat both identifier and text, one is kept. An empty table gives no rows. Other
    columns of docs aren't read. Texts that differ under one digest are told apart by their bytes.

    store is a path below which texts and state are kept, so that the next run counts this one's rows too; group_size
    and keep_id are then those of all runs so far. Without one, both are deleted at the end.
    """
    spark = docs.sparkSession
    path = store or work_path(spark, "dedup-store")
    plain = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    plain = plain.select("doc_id", digest(F.col("text")).alias("digest"), "text")
    run = f"{path}/content/{uuid.uuid4().hex}"
    plain.write.option("compression", "zstd").parquet(run)
    arrived = spark.read.schema(plain.schema).parquet(run)
    if not arrived.inputFiles():
        return arrived.limit(0).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.lit("").alias("text_sha256"))
    everything = spark.read.schema(plain.schema).parquet(f"{path}/content/*") if store else arrived
    with Scratch(spark) as scratch:
        kept = update_state(path, arrived, scratch)
        bad = scratch.keep(collisions(arrived, everything, kept), "dedup-collisions")
        state = kept.select("digest", F.col("doc_id").alias("keep_id"), F.col("locator").alias("at"), F.col("n").alias("group_size"), "n")
        sha = F.col("digest") if digest is _digest else F.unhex(F.sha2("text", 256))
        clean = _located(arrived, "doc_id", "digest", sha.alias("sha"))
        collided = not bad.isEmpty()
        if collided:
            clean = clean.join(maybe_broadcast(bad, BROADCAST_ROWS), "digest", "left_anti")
        clean = by_key(clean, state, "digest", kept).select("doc_id", "keep_id", "group_size", (F.col("locator") == F.col("at")).alias("kept"), "sha")
        if collided:
            # equal digests, different bytes: the text itself is the key
            text = _located(everything, "doc_id", "digest", "text").join(maybe_broadcast(bad, BROADCAST_ROWS), "digest", "left_semi")
            groups = text.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "locator")).alias("rep"), F.count("*").alias("group_size"))
            mine = _located(arrived, "doc_id", "digest", "text").join(groups, ["digest", "text"])
            clean = clean.unionByName(mine.select("doc_id", F.col("rep.doc_id").alias("keep_id"), "group_size", (F.col("locator") == F.col("rep.locator")).alias("kept"), F.unhex(F.sha2("text", 256)).alias("sha")))
        out = materialise(clean.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")), "dedup-verdict")
    if not store:
        remove(spark, path)
    return out


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    Null and empty texts are equal; rows without an identifier go where an equal text has one; of rows that repeat both
    identifier and text, one stays; an empty table stays empty; no column of docs clashes with ours.
    """
    verdict = exact_dedup(docs, id_col, text_col)
    dropped = verdict.where(~F.col("kept")).select(F.col("doc_id").alias("_drop_id"), F.col("text_sha256").alias("_drop_sha"))
    sha = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    repeated = not verdict.groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty()
    if repeated:
        # a kept and a dropped row can be alike here, so rows are first made unique; null and empty texts are alike
        plain = "_plain"
        while plain in docs.columns:
            plain += "_"
        docs = docs.withColumn(plain, F.coalesce(docs[text_col], F.lit(""))).dropDuplicates([id_col, plain]).drop(plain)
        sha = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
        kept = verdict.where("kept").select(F.col("doc_id").alias("_drop_id"), F.col("text_sha256").alias("_drop_sha"))
        return docs.join(kept, docs[id_col].eqNullSafe(kept["_drop_id"]) & (sha == kept["_drop_sha"]), "left_semi")
    dropped = maybe_broadcast(dropped, BROADCAST_ROWS)
    return docs.join(dropped, docs[id_col].eqNullSafe(dropped["_drop_id"]) & (sha == dropped["_drop_sha"]), "left_anti")
