"""Token ids in files of independent zstandard frames.

A store is a folder of shards in ascending order of doc_id and a table of shards. A shard is

    frame*  index  seek table

Frames are ordinary zstandard frames, one for each document (little-endian unsigned 32-bit ids). The index and the
seek table stand in skippable frames, so any zstandard reader passes over them. The index has, for each document, the
id, whether it is null, its frame, where it begins in that frame and its number of ids. The seek table is that of the
public seekable format: compressed size, size and checksum (lower half of XXH64) of each frame, then the number of
frames, a descriptor and a magic number, so it is found from the end of the file. A reader decompresses just the frames
of the documents that it wants and checks each frame.

A task writes shards of bounded size, each under a name of its own; the table of shards names those of the tasks that Spark committed, so
files of failed or repeated attempts are never read. The table has the least and greatest id of each shard, so a look-up
opens only the shards that may hold an id.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ARROW_ROWS, partitions, texts_of, work_path
from .tokens import encoder

END_ID = 2
#: Bytes of ids that are put together into a frame before the next begins; at 1, each document has its own.
FRAME_BYTES = 1
#: Documents and bytes of ids in one shard, after which the next begins: bounds the index that a reader loads.
SHARD_DOCS = 250_000
SHARD_BYTES = 1 << 30
LEVEL = 3
#: Fixed values of the public seekable format and of skippable frames.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG = 0x80
ENTRY, FOOTER, SKIP = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<II")
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("at", "<u8"), ("n", "<u8")])


class ChecksumError(ValueError):
    pass


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


@dataclass
class ShardWriter:
    """Adds documents one by one; holds one frame and the index."""

    uri: str
    frame_bytes: int = FRAME_BYTES
    frames: list[tuple[int, int, int]] = field(default_factory=list)
    index: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        fs, path = _open(self.uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self._out = fs.open_output_stream(path, compression=None)
        self._held: list[bytes] = []
        self._size = self.bytes = 0
        self._zip = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self._size and self._size + len(ids) > self.frame_bytes:
            self._flush()
        self.index.append((doc_id or 0, doc_id is None, len(self.frames), self._size, len(ids) // 4))
        self._held.append(ids)
        self._size += len(ids)
        self.bytes += len(ids)

    def _flush(self) -> None:
        whole = b"".join(self._held)
        packed = self._zip.compress(whole)
        self._out.write(packed)
        self.frames.append((len(packed), len(whole), xxhash.xxh64_intdigest(whole) & 0xFFFFFFFF))
        self._held, self._size = [], 0

    def close(self) -> None:
        if self._size:
            self._flush()
        index = np.array(self.index, INDEX).tobytes()
        self._out.write(SKIP.pack(INDEX_MAGIC, len(index)) + index)
        table = b"".join(ENTRY.pack(*f) for f in self.frames) + FOOTER.pack(len(self.frames), CHECKSUM_FLAG, FOOTER_MAGIC)
        self._out.write(SKIP.pack(TABLE_MAGIC, len(table)) + table)
        self._out.close()


class ShardReader:
    """Random access to one shard; holds the index and the last frame."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self._in = fs.open_input_file(path)
        size = self._in.size()
        n, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != FOOTER_MAGIC or flags != CHECKSUM_FLAG:
            raise ChecksumError(f"{uri} has no seek table")
        begin = size - FOOTER.size - n * ENTRY.size
        self.frames = list(ENTRY.iter_unpack(self._at(begin, n * ENTRY.size)))
        self.starts = np.concatenate(([0], np.cumsum([f[0] for f in self.frames], dtype=np.int64))).astype(np.int64)
        head = int(self.starts[-1])
        magic, length = SKIP.unpack(self._at(head, SKIP.size))
        if magic != INDEX_MAGIC:
            raise ChecksumError(f"{uri} has no index")
        self.index = np.frombuffer(self._at(head + SKIP.size, length), INDEX)
        self._frame: tuple[int, bytes] = (-1, b"")
        self._unzip = zstandard.ZstdDecompressor()

    def _at(self, begin: int, length: int) -> bytes:
        return bytes(self._in.read_at(length, begin))

    def frame(self, k: int) -> bytes:
        if self._frame[0] != k:
            packed, size, check = self.frames[k]
            whole = self._unzip.decompress(self._at(int(self.starts[k]), packed), max_output_size=size)
            if len(whole) != size or xxhash.xxh64_intdigest(whole) & 0xFFFFFFFF != check:
                raise ChecksumError(f"frame {k} is damaged")
            self._frame = (k, whole)
        return self._frame[1]

    def ids(self, row: int) -> bytes:
        _, _, k, at, n = self.index[row].item()
        return self.frame(k)[at : at + 4 * n]

    def find(self, doc_id: int) -> list[int]:
        """Rows of the index with this id; the index is in ascending order, nulls first."""
        nulls = int(self.index["null"].sum())
        ids = self.index["doc_id"][nulls:]
        return list(range(nulls + int(np.searchsorted(ids, doc_id)), nulls + int(np.searchsorted(ids, doc_id, "right"))))

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for row, (doc_id, null, *_) in enumerate(self.index.tolist()):
            yield (None if null else doc_id), self.ids(row)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as a store at path; the table of shards (shard, uri, docs, ids).

    Null text is empty, so such a document has just the end id. Rows that share an id stay as they are, in the order
    of their texts. A null id comes first; ids are whole numbers, and any other type is an error. An empty table gives
    no shards. Other columns aren't read.
    """
    spark = docs.sparkSession
    spark.conf.set(ARROW_ROWS, "512")
    plain = texts_of(docs, id_col, text_col).select(F.col("doc_id").cast("bigint"), "text")
    dealt = plain.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    end = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, n = TaskContext.get().partitionId(), None, 0
        tool = encoder(tokenizer)

        def finish() -> pa.RecordBatch:
            out.close()
            known = [d for d, null, *_ in out.index if not null]
            row = {"part": part, "shard": n, "uri": out.uri, "docs": len(out.index), "ids": out.bytes // 4, "nulls": len(out.index) - len(known), "low": min(known, default=None), "high": max(known, default=None)}
            return pa.RecordBatch.from_pylist([row], pa.schema([(k, pa.int32() if k in ("part", "shard") else pa.string() if k == "uri" else pa.int64()) for k in row]))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out and (len(out.index) >= SHARD_DOCS or out.bytes >= SHARD_BYTES):
                    yield finish()
                    out, n = None, n + 1
                out = out or ShardWriter(f"{path}/shards/{uuid.uuid4().hex}.zst")
                out.add(doc_id, tool.encode(text) + end)
        if out:
            yield finish()

    dealt.mapInArrow(write, TABLE).write.parquet(f"{path}/table")
    return shards(spark, path)


#: The table of shards: part and shard give their order, low and high the least and greatest id.
TABLE = "part int, shard int, uri string, docs bigint, ids bigint, nulls bigint, low bigint, high bigint"


def shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TABLE).parquet(f"{path}/table")


def _by_shard(table: DataFrame, fn, schema: str) -> DataFrame:
    """fn(uri, base) for each shard, in a task of its own; base is the number of ids in the shards before."""
    # ids are summed by part first: a row for each writing task, so the running sum in one task stays small
    parts = table.groupBy("part").agg(F.sum("ids").alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("ids").over(W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    based = table.withColumn("inside", inside).join(F.broadcast(parts), "part").select("part", "shard", "uri", (F.col("before") + F.col("inside")).alias("base"))
    dealt = based.repartitionByRange(max(1, min(table.count(), 10_000)), "part", "shard").select("uri", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from fn(uri, base)

    return dealt.mapInArrow(run, schema)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    A null id is null here too; rows that share an id are each given; an empty store gives no rows.
    """
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def digest(uri: str, base: int) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc_id, ids in ShardReader(uri):
            rows.append((doc_id, base, len(ids) // 4, zlib.crc32(ids)))
            base += len(ids) // 4
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return _by_shard(shards(spark, path), digest, ", ".join(f"{n} bigint" for n in names))


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids array<bigint>) of the documents asked for, or of all; only their frames are decompressed.

    Shards that can't hold an id aren't opened. An id that isn't there gives no row, one that several rows share gives
    them all; rows without an id come only where all are asked for.
    """
    table = shards(spark, path)
    if doc_ids is not None:
        wanted = [F.col("low").isNotNull() & (F.col("low") <= d) & (F.col("high") >= d) for d in doc_ids]
        table = table.where(reduce(lambda a, b: a | b, wanted, F.lit(False)))

    def take(uri: str, base: int) -> Iterator[pa.RecordBatch]:
        reader = ShardReader(uri)
        rows = range(len(reader.index)) if doc_ids is None else [r for d in doc_ids for r in reader.find(d)]
        for row in rows:
            doc_id, null = reader.index[row]["doc_id"], reader.index[row]["null"]
            ids = np.frombuffer(reader.ids(row), "<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([None if null else int(doc_id)], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return _by_shard(table, take, "doc_id bigint, ids array<bigint>")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as a store in the shared folder and read it back as digests."""
    path = work_path(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer, end_id, id_col, text_col)
    return read_digests(docs.sparkSession, path)
