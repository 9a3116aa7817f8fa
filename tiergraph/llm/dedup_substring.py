"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over WIDTH bytes picks trigger positions; text between triggers is a phrase. A trigger here is the
position with the least hash among those of one window, so every window of `size` bytes has just one, and equal windows
have it at the same place. A trigger together with the run of windows that it stands for is a phrase in context.

The dictionary holds each distinct phrase in context once, under a 128-bit digest of its bytes; the parse is the list of
(document, place, phrase). Corpus order is needed only as far as `size` bytes:

- parse: a phrase in context that occurs twice is repeated whole, as are all its windows;
- dictionary: equal windows of different phrases hold the same bytes after the trigger (GUARD of them), so the
  dictionary is dealt into buckets by these. In a bucket, the suffixes that begin at triggers are sorted: the suffix
  array of the parse, with the common prefixes of neighbours. The suffixes of phrases that begin b bytes before their
  trigger follow from those of b - 1 by one more byte to the left, ties in the order of the parse. Windows at b are equal
  just where neighbours in that order are equal in b bytes before and size - b after the trigger;
- buckets of more than HOT phrases are first dealt finer: their phrases are cut into runs of STEP windows, counted from
  the trigger, and settled in the same way under all bytes that such a run shares, then into single windows.

All counting is by groupBy with combining before the shuffle; documents are read again only to cut phrases and spans,
and joined by a digest of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, arrow_map, materialise, partitions, release, remove, stored

SIZE = 400
WIDTH = 8
GUARD = 64
STEP = 16
#: Phrases of one bucket that are sorted in one task.
HOT = 1024
#: Phrases that are sorted at a time, and bytes of them that are sent at a time.
SORTED = 4096
SENT = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Windows handled at a time in one text.
BLOCK = 1 << 21


def rolling_hash(data: bytes) -> np.ndarray:
    """A 32-bit hash of the WIDTH bytes from each position."""
    n = len(data) - WIDTH + 1
    out = np.empty(n, np.uint64)
    for at in range(min(WIDTH, n)):
        words = np.frombuffer(data, "<u8", (len(data) - at) // WIDTH, at)
        out[at::WIDTH] = words[: len(out[at::WIDTH])]
    out ^= out >> np.uint64(29)
    out *= MIX
    out >>= np.uint64(32)
    return out


def phrases(data: bytes, size: int = SIZE, guard: int = GUARD) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, number of windows, trigger) of each trigger's run of windows, block by block."""
    windows = len(data) - size + 1
    reach = size - guard + 1
    for base in range(0, max(windows, 0), BLOCK):
        count = min(BLOCK, windows - base)
        value = rolling_hash(data[base : base + count + size - 1])
        value <<= np.uint64(32)
        value |= np.arange(len(value), dtype=np.uint64)
        have = 1
        while 2 * have <= reach:
            value = np.minimum(value[:-have], value[have:])
            have *= 2
        if have < reach:
            value = np.minimum(value[: len(value) - (reach - have)], value[reach - have :])
        trigger = (value[:count] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(trigger)) + 1))
        yield first + base, np.diff(np.append(first, count)), trigger[first] + base


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    plain = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return plain.withColumn("h", F.xxhash64("doc_id", "text"))


FIELDS = "first int, n int, back int, guard bigint, p1 bigint, p2 bigint"
NAMES = ["doc_id", "h", "first", "n", "back", "guard", "p1", "p2"]


def _rows(batch: pa.RecordBatch, row: list[int], first: list[int], n: list[int], back: list[int], guard: list[int], digest: list[bytes]) -> pa.RecordBatch:
    """Columns 0 and 1 of batch are doc_id and h."""
    at = pa.array(row, pa.int64())
    pair = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
    arrays = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x, pa.int32()) for x in (first, n, back))]
    arrays += [pa.array(np.array(guard, np.uint64).view(np.int64)), pa.array(pair[:, 0]), pa.array(pair[:, 1])]
    return pa.RecordBatch.from_arrays(arrays, NAMES)


def parse(texts: DataFrame, size: int = SIZE, guard: int = GUARD) -> DataFrame:
    """The parse: (doc_id, h, first window, n windows, bytes from the first to the trigger, guard, p1, p2).

    guard is a digest of the bytes after the trigger, (p1, p2) one of the phrase in context.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for row, text in enumerate(batch.column(2).to_pylist()):
            data = _utf8(text)
            for first, n, trigger in phrases(data, size, guard):
                first, n, trigger = first.tolist(), n.tolist(), trigger.tolist()
                new = ([row] * len(first), first, n, [t - a for a, t in zip(first, trigger, strict=True)])
                new += ([xxhash.xxh3_64_intdigest(data[t : t + guard]) for t in trigger],)
                new += ([xxhash.xxh3_128_digest(data[a : a + k + size - 1]) for a, k in zip(first, n, strict=True)],)
                for whole, part in zip(out, new, strict=True):
                    whole += part
        return _rows(batch, *out)

    return arrow_map(texts.select("doc_id", "h", "text"), one, f"doc_id {kind}, h bigint, {FIELDS}")


def _on_document(a: DataFrame, b: DataFrame):
    return (a["h"] == b["h"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def finer(texts: DataFrame, wanted: DataFrame, step: int, size: int = SIZE) -> DataFrame:
    """The rows of wanted cut into runs of at most step windows, in the columns of parse().

    Runs are counted back from the trigger, so that equal windows fall into the same run of their phrase. guard is a
    digest of the bytes that all windows of an uncut run share.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()
    runs = wanted.groupBy("doc_id", "h").agg(*(F.collect_list(c).alias(c) for c in ("first", "n", "back")))
    whole = runs.join(texts, _on_document(runs, texts)).select(runs["doc_id"], runs["h"], "text", "first", "n", "back")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = _utf8(batch.column(2)[row].as_py())
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for first, n, back in zip(*(batch.column(k)[row].as_py() for k in (3, 4, 5)), strict=True):
                    trigger, last = first + back, first + n - 1
                    for k in range((trigger - last) // step, back // step + 1):
                        a, b = max(first, trigger - k * step - step + 1), min(last, trigger - k * step)
                        shared = trigger - k * step
                        mark = xxhash.xxh3_64_intdigest(data[shared : shared + size - step + 1], seed=k)
                        digest = xxhash.xxh3_128_digest(data[a : b + size], seed=trigger - a)
                        for x, y in zip(out, (row, a, b - a + 1, trigger - a, mark, digest), strict=True):
                            x.append(y)
                yield _rows(batch, *out)

    texts.sparkSession.conf.set(ARROW_ROWS, "512")
    return whole.mapInArrow(one, f"doc_id {kind}, h bigint, {FIELDS}")


def settle(parsed: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Spans (doc_id, h, a, b) of rows whose phrase occurs twice, and one row of each phrase that shares its guard with
    others, with the number of phrases that do."""
    phrase = ["guard", "p1", "p2"]
    entries = parsed.groupBy(phrase).agg(F.count("*").alias("times"), F.min(F.struct("h", "doc_id", "first", "n", "back")).alias("at"))
    # phrases with more than a quarter of an even share of the rows; four a partition at most, so they can be broadcast
    share = max(1, parsed.count() // (4 * partitions(parsed.sparkSession)))
    heavy = F.broadcast(entries.where(F.col("times") > share).select(phrase))
    light = entries.where(F.col("times").between(2, share)).select(phrase)
    twice = parsed.join(heavy, phrase, "left_semi").unionByName(parsed.join(heavy, phrase, "left_anti").join(light, phrase, "left_semi"))
    whole = twice.select("doc_id", "h", F.col("first").alias("a"), (F.col("first") + F.col("n") + size - 1).alias("b"))
    mixed = entries.groupBy("guard").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = entries.join(mixed, "guard").select("at.doc_id", "at.h", "at.first", "at.n", "at.back", "guard", "kinds")
    return whole, wanted


def dictionary(texts: DataFrame, wanted: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of wanted with the bytes of their phrases in context: (doc_id, h, first, n, back, guard, bytes)."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "h", "first", "n", "back", "guard", "bytes"]
    lists = names[2:6]
    runs = wanted.groupBy("doc_id", "h").agg(*(F.collect_list(c).alias(c) for c in lists))
    whole = runs.join(texts, _on_document(runs, texts)).select(runs["doc_id"], runs["h"], "text", *lists)
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0

            def sent(batch=batch) -> pa.RecordBatch:
                row, *columns = zip(*out, strict=True)
                at = pa.array(row, pa.int64())
                arrays = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))]
                return pa.RecordBatch.from_arrays(arrays, names)

            for row in range(batch.num_rows):
                data = _utf8(batch.column(2)[row].as_py())
                for first, n, back, guard in zip(*(batch.column(k)[row].as_py() for k in (3, 4, 5, 6)), strict=True):
                    out.append((row, first, n, back, guard, data[first : first + n + size - 1]))
                    held += n + size
                    if held > SENT:
                        yield sent()
                        out, held = [], 0
            if out:
                yield sent()

    texts.sparkSession.conf.set(ARROW_ROWS, "512")
    return whole.mapInArrow(one, f"doc_id {kind}, h bigint, first int, n int, back int, guard bigint, bytes binary")


def _padded(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), np.uint8).reshape(len(parts), width)


def _least(common: np.ndarray, longest: int) -> list[np.ndarray]:
    """Level k holds the least of each 2**k neighbours of common."""
    levels = [common]
    while 1 << len(levels) <= longest:
        last, half = levels[-1], 1 << len(levels) - 1
        levels.append(np.minimum(last[:-half], last[half:]) if len(last) > half else last[:0])
    return levels


def equal_windows(phrases: list[bytes], n: list[int], back: list[int], bucket: list[int], size: int = SIZE) -> list[tuple[int, int, int]]:
    """(phrase, a, b) for each longest run a <= window < b of windows of a phrase that others of its bucket hold too.

    Each phrase in context has n windows of size bytes, and its trigger stands back bytes from its beginning. Windows
    equal others only at the same distance from the trigger.
    """
    if len(phrases) < 2:
        return []
    # the parse: suffixes that begin at triggers, in order, bucket by bucket
    order = sorted(range(len(phrases)), key=lambda k: (bucket[k], phrases[k][back[k] :]))
    before, count, group = (np.array(x, np.int64)[order] for x in (back, n, bucket))
    after = _padded([phrases[k][back[k] :] for k in order], size + 1)
    unlike = after[1:] != after[:-1]
    common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), size).astype(np.int16)
    new = group[1:] != group[:-1]
    common[new] = -1
    classes = np.concatenate(([0], np.cumsum(new)))
    levels = _least(common, int(np.bincount(classes).max()))
    left = _padded([phrases[k][: back[k]][::-1] for k in order], int(before.max()) + 1)
    found = np.zeros((len(order), int(before.max()) + 2), bool)
    alive = np.arange(len(order))
    for b in range(int(before.max()) + 1):
        if b:  # one more byte to the left; the sort is stable, so equal ones stay in the parse's order
            stay = before[alive] >= b
            alive, classes = alive[stay], classes[stay]
            key = classes * 256 + left[alive, b - 1]
            at = np.argsort(key, kind="stable")
            alive, key = alive[at], key[at]
            classes = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) if len(key) else key
        same = classes[1:] == classes[:-1]
        several = np.concatenate((same, [False])) | np.concatenate(([False], same))
        alive, classes = alive[several[: len(alive)]], classes[several[: len(alive)]]
        if not len(alive):
            break
        has = before[alive] - count[alive] < b
        one, kin = alive[has], classes[has]
        pair = np.flatnonzero(kin[1:] == kin[:-1])
        lo, hi = one[pair], one[pair + 1]
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        shared = np.empty(len(pair), np.int16)
        for k in np.unique(level).tolist():
            some = level == k
            shared[some] = np.minimum(levels[k][lo[some]], levels[k][hi[some] - (1 << k)])
        hit = shared >= size - b
        found[lo[hit], b] = True
        found[hi[hit], b] = True
    edge = np.diff(found.astype(np.int8), axis=1, prepend=0)
    rows, starts = np.nonzero(edge == 1)
    ends = np.nonzero(edge == -1)[1]
    at = before[rows]
    return list(zip((order[k] for k in rows.tolist()), (at - ends + 1).tolist(), (at - starts + 1).tolist(), strict=True))


def sorted_spans(entries: DataFrame, size: int = SIZE) -> DataFrame:
    """Spans (doc_id, h, a, b) of windows of dictionary() that are equal to others of their bucket, by sorted suffixes."""
    spark = entries.sparkSession
    kind = entries.schema["doc_id"].dataType.simpleString()
    dealt = entries.repartition(partitions(spark), "guard").sortWithinPartitions("guard")

    def spans(held: pa.Table) -> pa.RecordBatch:
        n, back, guard, data = (held.column(c).to_pylist() for c in ("n", "back", "guard", "bytes"))
        found = equal_windows(data, n, back, guard, size)
        rows, a, b = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
        first = held.column("first").to_numpy()[rows]
        ids = held.select(["doc_id", "h"]).take(pa.array(rows)).combine_chunks()
        ids = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in ids.columns]
        return pa.RecordBatch.from_arrays([*ids, pa.array((first + a).astype(np.int32)), pa.array((first + b + size - 1).astype(np.int32))], ["doc_id", "h", "a", "b"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= SORTED:  # the last bucket may go on
                guard = held.column("guard").to_numpy()
                cut = int(np.searchsorted(guard, guard[-1]))
                if cut:
                    yield spans(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield spans(held)

    spark.conf.set(ARROW_ROWS, "1024")
    return dealt.mapInArrow(one, f"doc_id {kind}, h bigint, a int, b int")


def repeated_spans(texts: DataFrame, size: int = SIZE, guard: int = GUARD, step: int = STEP, hot: int = HOT) -> DataFrame:
    """(doc_id, h, a, b): byte spans that windows seen twice cover; they overlap, and may repeat."""
    spark, spans = texts.sparkSession, []
    rows, path = stored(parse(texts, size, guard), "substring-parse")
    for width in (step, 1, 0):
        whole, wanted = settle(rows, size)
        spans.append(materialise(whole, "substring-spans"))
        if width:
            wanted, kept = stored(wanted, "substring-wanted")
        remove(spark, path)  # what was made from it is in the shared folder by now
        release(spark)
        if not width:  # different single windows are just that
            break
        few, many = wanted.where(F.col("kinds") <= hot), wanted.where(F.col("kinds") > hot)
        spans.append(materialise(sorted_spans(dictionary(texts, few, size), size), "substring-spans"))
        more = not many.isEmpty()
        if more:
            rows, path = stored(finer(texts, many, width, size), "substring-finer")
        remove(spark, kept)
        release(spark)
        if not more:
            break
    out = spans[0]
    for part in spans[1:]:
        out = out.unionByName(part)
    return out


def merge(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of spans given as rows (a, b)."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(spans) - 1]))
    return list(zip(spans[new, 0].tolist(), reach[last].tolist(), strict=True))


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, guard: int = GUARD) -> DataFrame:
    """(doc_id, text, starts, ends): each document with its repeated spans, null where it has none."""
    texts = _texts(docs, id_col, text_col)
    spans = repeated_spans(texts, size, guard)
    by_doc = spans.groupBy("doc_id", "h").agg(F.collect_list("a").alias("starts"), F.collect_list("b").alias("ends"))
    return texts.join(by_doc, _on_document(texts, by_doc), "left").select(texts["doc_id"], "text", "starts", "ends")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, guard: int = GUARD) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    Removed is each byte within a string of size bytes that starts at two or more places of the table, judged on the
    texts as they come. Matches don't cross documents. Null text counts as empty; texts under size bytes lose nothing;
    rows that repeat both id and text are each other's copies. An empty table gives no rows. Other columns aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, removed, runs, sha, kept = [], [], [], [], []
        for text, starts, ends in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            data = _utf8(text)
            spans = merge(np.array([starts, ends], np.int64).T) if starts else []
            parts, last = [], 0
            for a, b in spans:
                parts.append(data[last:a])
                last = b
            left = b"".join([*parts, data[last:]])
            n.append(len(data))
            removed.append(len(data) - len(left))
            runs.append(len(spans))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(sha), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names)

    return arrow_map(with_spans(docs, id_col, text_col, size, guard), one, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
