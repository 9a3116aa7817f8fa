"""Near-duplicates by the exact Jaccard similarity of word shingles, for the near-duplicate stage.

A text is the set of the hashes of its shingles; equal sets are one node. Links come from two sources, and each is
checked on whole sets, so none is false:

- fingerprints within two bits of each other, by the segment-popcount grid (simhash.py): copies that were hardly
  changed, also in large groups;
- what a fingerprint can't reach (at a similarity of 0.8 about ten of 64 bits differ): all sets are put into one order
  of hashes, common ones last. Two sets of a similarity of t or more share a hash among the first n - ceil(t n) + 1 of
  each, and the first one they share leaves enough hashes behind it in both. Sets are joined by equality of such hashes,
  so no pair is missed.

Where more than a few sets have a hash, each is first checked against another one of them. Those that are connected by then need
no further check; those that aren't are joined in pairs after all.

Sets aren't stored: a text's shingles are hashed again where they are needed, which costs less than to move them. The
list of common hashes is drawn from a sample; it decides how many candidates there are, never which pairs are found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, Scratch, arrow_map, by_key, materialise, maybe_broadcast, partitions, shuffled, texts_of
from .components import components
from .simhash import BROADCAST_ROWS, SEED, majority, shingle_hashes
from .simhash import links as fingerprint_links

WIDTH = 5
SIMILARITY = 0.8
#: Texts under one hash up to which all pairs are checked at once.
HOT = 4
#: One text in SAMPLE is read for the list of common hashes: those in OFTEN sets or more of these, COMMON at most.
SAMPLE = 16
OFTEN = 4
COMMON = 100_000
#: Parts by which sets are told apart before they are compared whole.
SKETCH = 512
_EPS = 1e-9
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _node(hashes: np.ndarray) -> int:
    """One signed hash of a set, given in order."""
    value = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    return value - (value >> 63 << 64)


def nodes_of(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, node, fp, sketch) of texts (doc_id, text): a hash of the set, its fingerprint, and for each of SKETCH
    parts of all hashes whether the set has an odd number of them."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, fp, odd = [], [], []
        for text in batch.column(1).to_pylist():
            hashes = shingle_hashes(text, width)
            fp.append(majority(hashes))
            own = np.unique(hashes)
            node.append(_node(own))
            odd.append(np.packbits(np.bincount((own % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1))
        parts = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(odd).astype(np.uint8).view("<i8")), SKETCH // 64).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(fp, pa.int64()), parts], ["doc_id", "node", "fp", "sketch"])

    return arrow_map(texts, one, f"doc_id {kind}, node bigint, fp bigint, sketch array<bigint>")


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, hashes): the distinct shingle hashes of texts (doc_id, text) in ascending order."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(shingle_hashes(x, width)) for x in batch.column(1).to_pylist()]
        ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32))
        hashes = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found).view("<i8")))
        return pa.RecordBatch.from_arrays([batch.column(0), hashes], ["doc_id", "hashes"])

    return arrow_map(texts, one, f"doc_id {kind}, hashes array<bigint>", rows=128)


def common_hashes(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Hashes that many sets of a sample hold, in ascending order; how late each comes, the common last; and for each
    one text by chance that holds it. COMMON rows at most reach the driver."""
    some = sets_of(texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0), width)
    seen = some.select("doc_id", F.explode("hashes").alias("hash"))
    seen = seen.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("hash", "doc_id"), "doc_id"))["doc_id"].alias("lead")).where(F.col("n") >= OFTEN)
    rows = seen.orderBy(F.desc("n"), "hash").limit(COMMON).collect()
    values = np.array([r.hash for r in rows], np.int64)
    by_value = np.argsort(values)
    return values[by_value], -by_value, [rows[k].lead for k in by_value.tolist()]


def candidates(texts: DataFrame, width: int, similarity: float, hot: int) -> DataFrame:
    """(hash, at, size, u, v, dense): candidate pairs (u, v) of texts that share one of their first hashes.

    All neighbours of a text can be found by these. Where up to `hot` texts share a hash, there is a row for each pair.
    Where more do, the rows are dense: one for each text, and its pair is with another text that has the hash, or null.
    Hashes of the list of common ones are dealt by text, so no task gets all texts of one; the others are dealt by hash.
    """
    spark = texts.sparkSession
    kind = texts.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(common_hashes(texts, width))
    names = ["hash", "at", "size", "u", "v", "common"]

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        often, late, leads = shared.value
        out, lead, whole = [], [], []
        for text in batch.column(1).to_pylist():
            own = np.unique(shingle_hashes(text, width)).view("<i8")
            take = len(own) - math.ceil(similarity * len(own) - _EPS) + 1 if len(own) else 0
            whole.append(len(own))
            to = np.full(len(own), -1)
            if len(often) and len(own):
                at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                known = often[at] == own
                held = np.flatnonzero(known)
                held = held[np.argsort(late[at[held]])]
                to = np.concatenate((np.full(len(own) - len(held), -1), at[held]))
                own = np.concatenate((own[~known], own[held]))
            out.append(own[:take])
            lead.append(to[:take])
        sizes = np.array([len(x) for x in out], np.int64)
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        to = np.concatenate(lead).astype(np.int64)
        ids = batch.column(0)
        v = pa.array(leads, ids.type).take(pa.array(to, mask=to < 0)) if leads else pa.nulls(len(to), ids.type)
        arrays = [pa.array(np.concatenate(out)), pa.array(at.astype(np.int32)), pa.array(np.repeat(np.array(whole, np.int32), sizes)), ids.take(pa.array(np.repeat(np.arange(len(out)), sizes))), v, pa.array(to >= 0)]
        return pa.RecordBatch.from_arrays(arrays, names)

    rows = arrow_map(texts, first, f"hash bigint, at int, size int, u {kind}, v {kind}, common boolean", rows=128)
    dealt = rows.repartition(partitions(spark), F.when(F.col("common"), F.xxhash64("u")).otherwise(F.col("hash")))
    spark.conf.set(ARROW_ROWS, "10000")

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last hash so far, whose group may go on
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if not table.num_rows:
                continue
            whole = table.to_batches()[0]
            hashes = whole.column(0).to_numpy()
            # a listed hash's rows are of no group, so nothing of them is held back
            end = len(hashes) if whole.column(5)[-1].as_py() else int(np.flatnonzero(np.append(True, np.diff(hashes) != 0))[-1])
            held = whole.slice(end) if end < len(hashes) else None
            yield from _pairs(whole.slice(0, end), hot, similarity)
        if held is not None:
            yield from _pairs(held, hot, similarity)

    return dealt.sortWithinPartitions("common", "hash", "u").mapInArrow(grouped, f"hash bigint, at int, size int, u {kind}, v {kind}, dense boolean")


def _pairs(rows: pa.RecordBatch, hot: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows of whole groups, in order of hash, as candidates() gives them."""
    names = ["hash", "at", "size", "u", "v", "dense"]
    hashes, at, size = (rows.column(k).to_numpy() for k in (0, 1, 2))
    common = rows.column(5).to_numpy(zero_copy_only=False)
    if common.any():
        yield pa.RecordBatch.from_arrays([*rows.filter(pa.array(common)).columns[:5], pa.array(np.ones(int(common.sum()), bool))], names)
    alone = np.flatnonzero(~common)
    if not len(alone):
        return
    starts = alone[np.concatenate(([True], np.diff(hashes[alone]) != 0))]
    count = np.diff(np.append(starts, alone[-1] + 1))
    left, right, dense = [], [], []
    for n in np.unique(count[(count > 1) & (count <= hot)]).tolist():
        a, b = np.triu_indices(n, 1)
        of = starts[count == n]
        left.append((of[:, None] + a).ravel())
        right.append((of[:, None] + b).ravel())
        dense.append(np.zeros(len(left[-1]), bool))
    many = count > hot
    # each with the next in an order of chance, another one under each hash, so that few checks connect those alike
    group = np.repeat(np.flatnonzero(many), count[many])
    of = np.concatenate([np.zeros(0, np.int64), *(np.arange(s, s + n) for s, n in zip(starts[many].tolist(), count[many].tolist(), strict=True))])
    chance = (hashes[of].view(np.uint64) + of.astype(np.uint64)) * _MIX
    of = of[np.lexsort((chance ^ (chance >> np.uint64(29)), group))]
    left.append(of)
    right.append(np.where(np.append(np.diff(group) == 0, False), np.roll(of, -1), of) if len(of) else of)
    dense.append(np.ones(len(of), bool))
    u, v, dense = np.concatenate(left), np.concatenate(right), np.concatenate(dense)
    rest = np.minimum(size[u] - at[u], size[v] - at[v])
    enough = (rest * (1 + similarity) + _EPS >= (size[u] + size[v]) * similarity) & (u != v)
    some = enough | dense
    u, v, dense, enough = u[some], v[some], dense[some], enough[some]
    if len(u):
        arrays = [rows.column(k).take(pa.array(u)) for k in (0, 1, 2, 3)]
        yield pa.RecordBatch.from_arrays([*arrays, rows.column(3).take(pa.array(v, mask=~enough)), pa.array(dense)], names)


def _enough(similarity: float):
    """Whether what is left of both sets from a shared hash on allows the similarity."""
    left = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    return left * (1 + similarity) + _EPS >= (F.col("a.size") + F.col("b.size")) * similarity


def _near(similarity: float):
    """Whether the sketches allow the similarity: sets differ in as many hashes as their sketches at least."""
    apart = sum((F.bit_count(F.col("a.sketch")[k].bitwiseXOR(F.col("b.sketch")[k])) for k in range(1, SKETCH // 64)), F.bit_count(F.col("a.sketch")[0].bitwiseXOR(F.col("b.sketch")[0])))
    return apart * (1 + similarity) <= (F.col("a.size") + F.col("b.size")) * (1 - similarity) + _EPS


def _checked(pairs: DataFrame, texts: DataFrame, width: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Those of the pairs (u, v) of texts whose sets are as similar as that."""
    pairs = scratch.keep(pairs.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "similar-pairs")
    needed = scratch.keep(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), "similar-needed")
    whole = scratch.keep(sets_of(texts.join(maybe_broadcast(needed, BROADCAST_ROWS), "doc_id", "left_semi"), width), "similar-sets")
    a, b = whole.select(F.col("doc_id").alias("u"), F.col("hashes").alias("x")), whole.select(F.col("doc_id").alias("v"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    close = both * (1 + similarity) + _EPS >= (F.size("x") + F.size("y")) * similarity
    return scratch.keep(pairs.join(shuffled(a), "u").join(shuffled(b), "v").where(close).select("u", "v"), "similar-links")


def by_fingerprint(known: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of texts (doc_id, fp), two for a text at most: with the least text of its fingerprint, and of the least
    fingerprint that its own links with."""
    fps = scratch.keep(known.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "similar-fps")
    same = by_key(known.select("fp", F.col("doc_id").alias("u")), fps.where("n > 1"), "fp", fps).select("u", F.col("least").alias("v"))
    a, b = (fps.select(F.col("fp").alias(x), F.col("least").alias(f"_{x}")) for x in "uv")
    near = fingerprint_links(fps.select("fp"), scratch=scratch).groupBy("v").agg(F.min("u").alias("u"))
    near = near.join(shuffled(a), "u").join(shuffled(b), "v")
    return same.unionByName(near.select(F.col("_u").alias("u"), F.col("_v").alias("v")))


def links(texts: DataFrame, known: DataFrame, sketches: DataFrame, width: int, similarity: float, hot: int, scratch: Scratch) -> DataFrame:
    """(node, root) of texts that are linked: those of the similarity, and all connected through such.

    texts: (doc_id, text) of different sets; known: (doc_id, fp) of the same rows; sketches: (doc_id, sketch).
    """
    found = scratch.keep(candidates(texts, width, similarity, hot), "similar-candidates")
    pairs = found.where("v IS NOT NULL").select("u", "v").unionByName(by_fingerprint(known, scratch))
    edges = _checked(pairs, texts, width, similarity, scratch)
    roots = components(edges, scratch)
    dense = found.where("dense").select("hash", "at", "size", F.col("u").alias("node"))
    joined = dense.join(shuffled(roots.withColumnRenamed("node", "linked")), F.col("node") == F.col("linked"), "left")
    joined = scratch.keep(joined.select("hash", "at", "node", "size", F.coalesce("root", "node").alias("root")), "similar-joined")
    split = scratch.keep(joined.groupBy("hash").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("hash"), "similar-split")
    if split.isEmpty():
        return roots
    left = joined.join(maybe_broadcast(split, BROADCAST_ROWS), "hash", "left_semi").join(shuffled(sketches), F.col("node") == F.col("doc_id")).drop("doc_id")
    left = scratch.keep(left, "similar-left")
    on = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root"))
    rest = left.alias("a").join(shuffled(left.alias("b")), on & _enough(similarity) & _near(similarity)).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    more = _checked(rest, texts, width, similarity, scratch)
    return roots if more.isEmpty() else components(edges.unionByName(more), scratch)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, component_id (the smallest id reachable). Ids are distinct and not null.

    Texts link where the Jaccard similarity of their sets of shingles, words in lower case, is `similarity` or more.
    Shorter texts are one shingle; texts without words, null among them, link with each other only. Texts of any length
    are read whole. Equal sets are one node. An empty table gives no rows. Other columns aren't read.
    """
    with Scratch(docs.sparkSession) as scratch:
        texts = texts_of(docs, id_col, text_col)
        rows = scratch.keep(nodes_of(texts, width), "similar-rows")
        nodes = scratch.keep(rows.groupBy("node").agg(F.min(F.struct("doc_id", "fp")).alias("least"), F.count("*").alias("n")), "similar-nodes")
        known = nodes.select("least.doc_id", "least.fp", "n")
        if not known.where("n > 1").isEmpty():
            more = scratch.keep(rows.join(shuffled(known), "doc_id", "left_anti").select("doc_id"), "similar-more")
            texts = texts.join(maybe_broadcast(more, BROADCAST_ROWS), "doc_id", "left_anti")
        roots = links(texts, known, rows.select("doc_id", "sketch"), width, similarity, hot, scratch)
        whole = nodes.join(shuffled(roots.withColumnRenamed("node", "linked")), F.col("least.doc_id") == F.col("linked"), "left")
        whole = whole.select("node", F.coalesce("root", "least.doc_id").alias("component_id"), "n")
        return materialise(by_key(rows.select("doc_id", "node"), whole, "node", nodes).select("doc_id", "component_id"), "similar-components")
