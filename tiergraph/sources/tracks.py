"""Signal tracks: SSFF files in bundles as rows of frames, stored by time, and what segments ask of them.

Files are read one at a time by the tasks and given on in pieces of FRAMES_AT_ONCE rows. Store the rows (save()) before
asking for ranges of long recordings: a range then reads only the row groups that may hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .annot_json import BUNDLE, SESSION

#: The types that a column of a track file may have.
DTYPES = {"CHAR": "i1", "BYTE": "u1", "SHORT": "i2", "LONG": "i4", "FLOAT": "f4", "DOUBLE": "f8"}
RULE = b"-----------------\n"
FRAMES_AT_ONCE = 100_000
#: Milliseconds of the bins on which segments and frames meet.
BIN_MS = 1000

TRACKS = "session string, bundle string, extension string, field string, frame bigint, t double, values array<double>"


def parse_ssff(content: bytes) -> tuple[float, float, np.ndarray]:
    """(frames a second, time of the first frame in seconds, frames as a structured array) of a file's bytes."""
    head, mark, body = content.partition(RULE)
    if not mark or not head.startswith(b"SSFF"):
        raise ValueError("not a track file")
    order, rate, start, columns = "<", None, 0.0, []
    for line in head.decode("latin-1").splitlines():
        word, *rest = line.split()
        if word == "Machine":
            order = ">" if rest[0] == "SPARC" else "<"
        elif word == "Record_Freq":
            rate = float(rest[0])
        elif word == "Start_Time":
            start = float(rest[0])
        elif word == "Column":
            columns.append((rest[0], order + DTYPES[rest[1]], (int(rest[2]),)))
    if not rate or not columns:
        raise ValueError("a track file needs a frame rate and a column")
    kind = np.dtype(columns)
    return rate, start, np.frombuffer(body, kind, count=len(body) // kind.itemsize)


def ssff(rate: float, start: float, columns: dict[str, tuple[str, np.ndarray]]) -> bytes:
    """A track file of columns: name to (type, frames x values)."""
    shaped = {name: (kind, np.asarray(x).reshape(len(x), -1)) for name, (kind, x) in columns.items()}
    rows = np.zeros(len(next(iter(shaped.values()))[1]), np.dtype([(n, "<" + DTYPES[k], (x.shape[1],)) for n, (k, x) in shaped.items()]))
    for name, (_, x) in shaped.items():
        rows[name] = x
    lines = ["SSFF -- (c) SHLRC", "Machine IBM-PC", f"Record_Freq {rate}", f"Start_Time {start}", *[f"Column {n} {k} {x.shape[1]}" for n, (k, x) in shaped.items()]]
    return "".join(f"{x}\n" for x in lines).encode() + RULE + rows.tobytes()


def read_tracks(spark: SparkSession, folder: str, extension: str, fields: list[str] | None = None) -> DataFrame:
    """TRACKS rows of the files with the extension: frames count from 1, t is in milliseconds.

    A file that isn't a track file is an error; fields that a file lacks give no rows.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(folder)
    path = F.expr("url_decode(path)")
    files = found.select(F.regexp_extract(path, SESSION, 1).alias("session"), F.regexp_extract(path, BUNDLE, 1).alias("bundle"), "content")

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for session, bundle, content in pdf.itertuples(index=False):
                rate, start, data = parse_ssff(content)
                for field in data.dtype.names:
                    for first in range(0, len(data) if fields is None or field in fields else 0, FRAMES_AT_ONCE):
                        part = data[field][first : first + FRAMES_AT_ONCE].astype(float)
                        at = np.arange(first, first + len(part))
                        made = pd.DataFrame({"frame": at + 1, "t": (start + at / rate) * 1000, "values": part.tolist()})
                        yield made.assign(session=session, bundle=bundle, extension=extension, field=field)

    return files.mapInPandas(rows, TRACKS)


def save(tracks: DataFrame, path: str) -> DataFrame:
    """Tracks as Parquet in folders by field, sorted by bundle and time in each file, so that a range skips row groups."""
    parts = tracks.repartition("session", "bundle", "field", F.floor(F.col("t") / 600_000))
    parts.sortWithinPartitions("session", "bundle", "t").write.mode("overwrite").partitionBy("extension", "field").parquet(path)
    return tracks.sparkSession.read.schema(TRACKS).parquet(path)


def between(tracks: DataFrame, begin_ms: float, end_ms: float | None = None, field: str | None = None) -> DataFrame:
    """Frames from begin_ms to end_ms, both included; to the end if that is None or 0."""
    out = tracks.where(F.col("t") >= begin_ms)
    out = out.where(F.col("t") <= end_ms) if end_ms else out
    return out.where(F.col("field") == field) if field else out


def of_segments(found: DataFrame, tracks: DataFrame, columns: list[str]) -> DataFrame:
    """columns of each segment with the frames from its start to its end, both included; segments without frames give none.

    Both sides meet on bins of a second within a bundle, which is an equality; a frame lies in one bin, so no pair comes
    twice.
    """
    keys = ["session", "bundle"]
    bins = F.sequence(F.floor(F.col("start") / BIN_MS), F.floor(F.col("end") / BIN_MS))
    taken = [c for c in tracks.columns if c not in keys]
    left = found.where("end >= start").select("*", F.explode(bins).alias("_bin")).alias("s")
    right = tracks.select("*", F.floor(F.col("t") / BIN_MS).alias("_bin")).alias("f")
    met = left.join(right, [F.col(f"s.{k}") == F.col(f"f.{k}") for k in (*keys, "_bin")] + [F.col("f.t").between(F.col("s.start"), F.col("s.end"))])
    return met.select(*[F.col(f"s.{c}").alias(c) for c in columns], *[F.col(f"f.{c}").alias(c) for c in taken])


def with_signal(found: DataFrame, files: DataFrame, extension: str | None = None) -> DataFrame:
    """Segments whose bundle has a signal file (with the extension); the others have nothing to be measured on."""
    there = files.where(F.col("extension") == extension) if extension else files
    return found.join(there.select("session", "bundle").distinct(), ["session", "bundle"], "left_semi")


def sample_window(start: Column, end: Column, cut: Column, n: Column, last: Column | None = None) -> Column:
    """(first, last) of n samples around the point that lies at cut (0 to 1) of start to end.

    The window starts at the sample nearest to half of n before that point, ties to even, but not before start; with
    last, the final sample of the track, it is moved back so as not to go beyond.
    """
    first = F.greatest(F.rint(start + cut * (end - start) - n / 2).cast("bigint"), start.cast("bigint"))
    if last is not None:
        first = F.least(first, (last - n + 1).cast("bigint"))
    return F.struct(first.alias("first"), (first + n - 1).cast("bigint").alias("last"))
