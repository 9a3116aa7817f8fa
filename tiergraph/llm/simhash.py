"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint of 64 bits becomes the vector of its 16 nibbles' bit counts. One differing bit moves that vector by at
most one step, so the Manhattan distance of two vectors is a lower bound of the Hamming distance. Two vectors within
distance 2 have a common grid point within one step of each, so each fingerprint is placed at its own point and the 32
points around it, and points are joined by equality; the bits then decide.

Only distinct fingerprints are joined. Grid points with more than HOT fingerprints aren't joined in pairs: all
fingerprints there are placed at their own value and the 64 values one bit away. Two of them are within two bits just
when they share such a value, at most 65 share one, and it is enough to link each to the least.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, by_key, materialise, maybe_broadcast, shuffled, texts_of
from .components import components

SEED = 42
BITS = 64
SEGMENT = 4
DISTANCE = 2
HOT = 512
BROADCAST_ROWS = 100_000
CHUNK = 1 << 14


def shingle_hashes(text: str, width: int = 3) -> np.ndarray:
    """XXH64 of each run of width words, repeats included; fewer words give one run, none give none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    count = len(words) - width + 1
    if count < 2:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:count].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], "<u8", count)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; none give zero."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str, width: int = 3) -> int:
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as a signed 64-bit number; null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(x, width) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return arrow_map(texts_of(docs, id_col, text_col), one, f"doc_id {kind}, fp bigint")


def grid_point(fp):
    """The bit count of each nibble, plus one, in three bits each: a step either way stays in its three bits."""
    parts = [F.shiftleft((F.bit_count(F.shiftright(fp, SEGMENT * k).bitwiseAND(F.lit(15))) + 1).cast("bigint"), 3 * k) for k in range(BITS // SEGMENT)]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def links(nodes: DataFrame, hot: int = HOT, scratch: Scratch | None = None) -> DataFrame:
    """Edges (u, v) between the distinct values of nodes.fp: all pairs within two bits outside hot grid points, and
    inside those as many as keep the same values connected."""
    scratch = scratch or Scratch(nodes.sparkSession)
    steps = [0, *(sign << 3 * k for k in range(BITS // SEGMENT) for sign in (1, -1))]
    own = nodes.select("fp", grid_point(F.col("fp")).alias("own"))
    placed = own.select("fp", "own", F.explode(F.array(*[F.lit(s).cast("bigint") for s in steps])).alias("step")).select("fp", (F.col("own") + F.col("step")).alias("point"))
    crowded = scratch.keep(placed.groupBy("point").count().where(F.col("count") > hot).select("point"), "simhash-hot")
    some_hot = not crowded.isEmpty()
    crowded = maybe_broadcast(crowded, BROADCAST_ROWS) if some_hot else crowded
    cold = placed.join(crowded, "point", "left_anti") if some_hot else placed
    a, b = cold.select("point", F.col("fp").alias("u")), cold.select("point", F.col("fp").alias("v"))
    apart = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    found = a.join(shuffled(b), (a["point"] == b["point"]) & (F.col("u") < F.col("v")) & (apart <= DISTANCE)).select("u", "v")
    if some_hot:
        dense = placed.join(crowded, "point", "left_semi").select("fp").distinct()
        flips = F.array(F.lit(0).cast("bigint"), *[F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("bigint") for k in range(BITS)])
        near = dense.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
        least = near.groupBy("value").agg(F.min("fp").alias("u"), F.sort_array(F.collect_set("fp")).alias("all"))
        found = found.unionByName(least.where(F.size("all") > 1).select("u", F.explode("all").alias("v")).where("u != v"))
    return found.distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable).

    Fingerprints link at two or fewer differing bits. Null and empty texts have fingerprint zero and link like any
    other. Equal fingerprints are one node, so copies and repeated rows aren't expanded into pairs. Null ids are
    skipped in the smallest id of a component. An empty table gives no rows. Other columns aren't read.
    """
    with Scratch(docs.sparkSession) as scratch:
        fps = scratch.keep(fingerprints(docs, id_col, text_col, width), "simhash-fps")
        return materialise(_named(fps, hot, scratch), "simhash-components")


def _named(fps: DataFrame, hot: int, scratch: Scratch) -> DataFrame:
    nodes = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    roots = components(links(nodes, hot, scratch), scratch)
    named = roots.join(shuffled(nodes), roots["node"] == nodes["fp"]).groupBy("root").agg(F.min("least").alias("linked"))
    named = named.join(shuffled(nodes.select(F.col("fp").alias("root"), "least")), "root").select("root", F.least("linked", "least").alias("component_id"))
    placed = roots.select("node", "root").unionByName(named.select(F.col("root").alias("node"), "root")).join(shuffled(named), "root")
    whole = nodes.join(shuffled(placed), nodes["fp"] == placed["node"], "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")
    out = by_key(fps, whole, "fp", nodes)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, find=near_components) -> DataFrame:
    """One row of docs for each near-duplicate component, with all columns: the one with the smallest id.

    `find` gives the components, as near_components() does; `width` is the number of words in a shingle. Null and empty
    texts are alike, texts of any length are read whole, an empty table stays empty, and no column of docs clashes with
    ours. Rows without an id come after all others. Of rows of a component that share the smallest id, or that have
    none, the first read stays.
    """
    ids = docs.groupBy(docs[id_col].alias("doc_id")).count()
    if not ids.where("count > 1 OR doc_id IS NULL").isEmpty():
        return _keep_numbered(docs, id_col, text_col, width, find)
    found = find(docs, id_col, text_col, width)
    dropped = found.where("doc_id != component_id").select(F.col("doc_id").alias("_drop_id"))
    dropped = maybe_broadcast(dropped, BROADCAST_ROWS)
    return docs.join(dropped, docs[id_col] == dropped["_drop_id"], "left_anti")


def _keep_numbered(docs: DataFrame, id_col: str, text_col: str, width: int, find) -> DataFrame:
    """keep_one_of_each() where ids are missing or repeat, so that rows are told apart by a number of their own."""
    number = "_row"
    while number in docs.columns:
        number += "_"
    rows = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "simhash-rows")
    found = find(rows, number, text_col, width).select(F.col("doc_id").alias("_n"), "component_id")
    ids = rows.select(F.col(number).alias("_n"), F.col(id_col).alias("_id"))
    first = found.join(shuffled(ids), "_n").groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_n")).alias("first"))
    first = first.select(F.col("first._n").alias("_keep"))
    return rows.join(shuffled(first), rows[number] == first["_keep"], "left_semi").drop(number)
