"""Best-fit packing with exact complements first.

The plan is made over counts of lengths. There are at most `size` lengths, so the histogram and the plan are bounded
whatever the corpus. From the longest length down, the rest of a sequence is filled exactly by one, two or three
lengths, as many times as the counts allow; what has no exact complement goes best-fit. Single, pair and triple sums are
indexed by hash under the counts, so no exact filling is missed and no combination is tried twice.
Pieces then take their places by their rank among pieces of the same length, counted in salted parts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, materialise, texts_of
from .tokens import encoder

SIZE = 2048
END_ID = 0
#: Pieces for each of the parts in which the pieces of one length are ranked; at least LEAST_SALTS parts.
SALT_ROWS = 50_000
LEAST_SALTS = 256


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids and an end id, cut only where they exceed size."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool, rows = encoder(tokenizer), []
        for at, text in enumerate(batch.column(1).to_pylist()):
            ids = tool.encode(text) + end
            for k, a in enumerate(range(0, len(ids), 4 * size)):
                part = ids[a : a + 4 * size]
                rows.append((at, k, a // 4, len(part) // 4, zlib.crc32(part)))
        at, k, start, length, crc = zip(*rows, strict=True)
        arrays = [batch.column(0).take(pa.array(at)), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names)

    return arrow_map(texts_of(docs, id_col, text_col), cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Complements:
    """Hash index of the sums of one, two and three available lengths.

    For each sum that is asked for, the index holds where in the descending order of its combinations the first one that
    is still available stands. Counts only fall while packing, so what is passed over never comes back, and no
    combination is tried twice for a sum.
    """

    def __init__(self, count: np.ndarray):
        self.count = count
        self.pairs: dict[int, int] = {}
        self.triples: dict[int, int] = {}

    def pair(self, total: int, held: int = 0) -> tuple[int, int] | None:
        """Two that add up to total, the longer first; one of the length held is spoken for."""
        count, a, lasting = self.count, self.pairs.get(total, total - 1), None
        while 2 * a >= total:
            b = total - a
            if count[a] and count[b] > (a == b):
                if count[a] > (a == held) and count[b] > (a == b) + (b == held):
                    self.pairs[total] = a if lasting is None else lasting
                    return a, b
                lasting = a if lasting is None else lasting  # gone only while one is held
            a -= 1
        self.pairs[total] = a if lasting is None else lasting
        return None

    def triple(self, total: int) -> list[int] | None:
        """Three that add up to total, one of them with the pair that fills what it leaves."""
        c = self.triples.get(total, 1)
        while 3 * c <= total:
            if self.count[c] and (found := self.pair(total - c, held=c)):
                self.triples[total] = c
                return sorted((*found, c), reverse=True)
            c += 1
        self.triples[total] = c
        return None

    def fill(self, gap: int) -> list[int] | None:
        """One, two or three available lengths that add up to gap."""
        if self.count[gap]:
            return [gap]
        found = self.pair(gap) or self.triple(gap)
        return list(found) if found else None


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """(lengths in one sequence, number of such sequences); uses each length as often as the histogram has it."""
    count = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    made: list[tuple[list[int], int]] = []
    if count[size]:
        made.append(([size], int(count[size])))
        count[size] = 0
    sums = Complements(count)
    for length in range(size - 1, 0, -1):
        while count[length]:
            count[length] -= 1
            found = sums.fill(size - length)
            count[length] += 1
            if not found:
                break
            use = defaultdict(int)
            for x in (length, *found):
                use[x] += 1
            times = min(int(count[x]) // k for x, k in use.items())
            for x, k in use.items():
                count[x] -= k * times
            made.append(([length, *found], times))
    return made + _best_fit(count, size)


def _best_fit(count: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over counts: open sequences of one filling and room are handled at once."""
    rooms: list[int] = []
    open_at: dict[int, list[tuple[list[int], int]]] = defaultdict(list)

    def put(filling: list[int], n: int) -> None:
        room = size - sum(filling)
        if room not in open_at:
            insort(rooms, room)
        open_at[room].append((filling, n))

    for length in range(size, 0, -1):
        n = int(count[length])
        while n:
            at = bisect_right(rooms, length - 1)
            if at < len(rooms):
                room = rooms[at]
                filling, m = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[at]
                used = min(n, m)
                if m > used:
                    put(filling, m - used)
                put([*filling, length], used)
                n -= used
            else:
                fit = size // length
                used = n // fit
                if used:
                    put([length] * fit, used)
                if n % fit:
                    put([length] * (n % fit), 1)
                n = 0
    return [x for room in rooms for x in open_at[room]]


def places(made: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: ranks from which a run of places starts, the sequence of the first of them, and the offset."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    base = 0
    for filling, n in made:
        offset = 0
        for length in filling:
            runs[length].append((rank[length], base, offset))
            rank[length] += n
            offset += length
        base += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one end id. Repeated rows and ids are packed each on its own. An empty table gives no
    rows. Other columns aren't read. Sequences are numbered from 0 without gaps, and pieces in one have no gaps.
    """
    cut = pieces(docs, tokenizer, size, end_id, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    cut = materialise(cut, "pack-pieces")
    salts = max(LEAST_SALTS, cut.count() // SALT_ROWS)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    counts = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # at most size rows reach the driver
    made = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    base = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.row_number().over(W.partitionBy("length", "salt").orderBy("uid")) - 1
    ranked = cut.withColumn("within", within).join(base, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("within") + F.col("base")).cast("bigint").alias("rank"))
    shared = docs.sparkSession.sparkContext.broadcast(places(made))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            first, base, where = shared.value[int(length[part[0]])]
            at = np.searchsorted(first, rank[part], "right") - 1
            sequence[part] = base[at] + rank[part] - first[at]
            offset[part] = where[at]
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(ranked, place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint", rows=10_000)
