"""Measurements of segments and files by user functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import frame_index, nominal_f1
from ..schemas import KEYS
from . import metadata

Measure = Callable[..., Any]


def derive_parameters(found: DataFrame, fields: list[str], user: dict[str, Any] | None = None) -> DataFrame:
    """Adds nominalF1 and maxFormantHz from Gender and Age, where the user gives none; user values win."""
    user = user or {}
    gender = F.col("Gender") if "Gender" in fields else F.lit(None).cast("string")
    age = F.col("Age").try_cast("double") if "Age" in fields else F.lit(None).cast("double")
    f1 = F.lit(user["nominalF1"]) if "nominalF1" in user else nominal_f1(gender, age)
    out = found.withColumn("nominalF1", f1.cast("double"))
    most = F.lit(user["maxFormantHz"]) if "maxFormantHz" in user else F.col("nominalF1") * 10
    return out.withColumn("maxFormantHz", most.cast("double"))


def resample(track: DataFrame, frames: str, at: list[float]) -> DataFrame:
    """Rows for the frames of an array column at relative positions, with the position as time_point."""
    if any(not 0 <= x <= 1 for x in at):
        raise ValueError("positions lie between 0 and 1")
    points = F.explode(F.array(*map(F.lit, map(float, at)))).alias("time_point")
    picked = track.where(F.size(frames) > 0).select("*", points)
    return picked.withColumn("frame", F.element_at(frames, frame_index(F.col("time_point"), F.size(frames))))


def columns_of(result: Any) -> tuple[dict[str, list], int]:
    """A frame, a dict, a sequence or a number as columns, and their number of rows."""
    if isinstance(result, pd.DataFrame):
        return {str(c): result[c].tolist() for c in result.columns}, len(result)
    if isinstance(result, dict):
        long = [len(v) for v in result.values() if isinstance(v, list | tuple | np.ndarray)]
        n = long[0] if long else 1
        if any(k != n for k in long):
            raise ValueError("columns differ in length")
        return {k: list(v) if isinstance(v, list | tuple | np.ndarray) else [v] * n for k, v in result.items()}, n
    values = np.atleast_1d(result).tolist()
    return {"value": values}, len(values)


def rows_of(result: Any) -> pd.DataFrame:
    return pd.DataFrame(columns_of(result)[0])


def quantify(found: DataFrame, measure: Measure, schema: str, at: list[float] | None = None, parameters: dict[str, Any] | None = None, columns: list[str] | None = None, by: tuple[str, ...] = ("session", "bundle"), pieces: int = 8, errors: bool = False) -> DataFrame:
    """Segments with the rows that measure gives for each.

    measure(segment, **parameters) gets a dict of the segment's columns; schema is that of what it returns. Segments of
    one bundle are dealt to `pieces` tasks at most, so that a bundle with most of the segments doesn't hold up the rest.
    A segment whose measure fails gives no rows, or with errors=True one row of nulls and the message in `error`.
    """
    if at is not None and any(not 0 <= x <= 1 for x in at):
        raise ValueError("positions lie between 0 and 1")
    parameters, keep = parameters or {}, list(columns or found.columns)
    extra = ", time_point double" if at is not None else ""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(*keep).schema) + f", {schema}{extra}" + (", error string" if errors else "")

    names = [f.strip().split()[0].strip("`") for f in _split(ddl)]
    measured = [n for n in names[len(keep) :] if n not in ("time_point", "error")]

    def measured_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {n: [] for n in names}
        for row in pdf[keep].to_dict("records"):
            error = None
            try:
                made, n = columns_of(measure(dict(row), **parameters))
                if at is not None:
                    index = [max(1, min(n, round(x * n))) - 1 for x in at] if n else []
                    made = {k: [v[i] for i in index] for k, v in made.items()} | {"time_point": [float(x) for x in at] if n else []}
                    n = len(index)
            except Exception as e:  # one segment's failure is reported in its row, and the others go on
                if not errors:
                    continue
                made, n, error = {}, 1, f"{type(e).__name__}: {e}"
            for name in keep:
                out[name] += [row[name]] * n
            for name in measured + (["time_point"] if at is not None else []):
                out[name] += made.get(name) or [None] * n
            if errors:
                out["error"] += [error] * n
        return pd.DataFrame(out, columns=names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(measured_rows, frames)

    piece = F.pmod(F.xxhash64(*[c for c in ("start_item_id", "start") if c in keep] or keep), F.lit(pieces))
    # segments of a file come one after another, so that a measure may keep the file open; no group is gathered whole
    dealt = found.select(*keep).withColumn("_piece", piece).repartition(*by, "_piece").sortWithinPartitions(*by)
    return dealt.mapInPandas(run, ddl)


def _split(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for k, c in enumerate(ddl):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(ddl[start:k])
            start = k + 1
    return [*out, ddl[start:]]


def quantify_cached(found: DataFrame, cache: DataFrame | None, compute: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """Rows of cache for segments that it has, and computed rows for the others; all carry the keys."""
    if cache is None:
        return compute(found)
    have = cache.join(found.select(*keys).distinct(), keys, "left_semi")
    return have.unionByName(compute(found.join(cache.select(*keys).distinct(), keys, "left_anti")), allowMissingColumns=True)


#: Segments of one group that a task holds at once in quantify_pairs().
GROUP_ROWS = 1_000_000


def quantify_pairs(x: DataFrame, y: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, by_bundle: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """fn on the segments of both lists in each session, or bundle; groups that only one list has are passed over.

    fn gets whole groups, so one of more than group_rows segments is an error before anything is measured.
    """
    keys = [k for k in (KEYS if by_bundle else KEYS[:2]) if k in x.columns and k in y.columns]
    sizes = x.select(*keys).unionByName(y.select(*keys)).groupBy(*keys).count()
    if too_large := sizes.where(F.col("count") > group_rows).head(1):
        raise ValueError(f"{too_large[0]} has over {group_rows} segments: group by bundle, or measure parts of it")
    a, b = x.join(y.select(*keys).distinct(), keys, "left_semi"), y.join(x.select(*keys).distinct(), keys, "left_semi")
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # both lists may come from the same tables
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(fn, schema)


def enrich(files: DataFrame, measure: Measure, schema: str, parameters: dict[str, Any] | None = None) -> DataFrame:
    """A row per file with the arrays that measure gives as a track, or the error; files are worked on where they are dealt."""
    parameters = parameters or {}
    names = [f.strip().split()[0] for f in _split(schema)]
    inner = ", ".join(":".join(f.split(maxsplit=1)) for f in _split(schema))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + f", track array<struct<{inner}>>, error string"

    def run(frames):
        for pdf in frames:
            tracks, errors = [], []
            for row in pdf.to_dict("records"):
                try:
                    tracks.append(rows_of(measure(row, **parameters))[names].to_dict("records"))
                    errors.append(None)
                except Exception as e:  # reported in the file's row
                    tracks.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(track=tracks, error=errors)

    return files.mapInPandas(run, ddl)


furnish = enrich


def with_metadata(corpus, found: DataFrame, fields: list[str]) -> DataFrame:
    """Segments with the metadata that their measures need."""
    needed = found.select(*KEYS).distinct()
    return found.join(metadata.wide(corpus, fields).join(needed, KEYS, "left_semi"), KEYS, "left")


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with the values of the last row of right at or before its time, by keys: one union and one window, no theta join."""
    a = left.select(*[F.col(k) for k in keys], F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_found"))
    b = right.select(*[F.col(k) for k in keys], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_found"))
    last = F.last("_found", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, W.currentRow))
    out = a.unionByName(b).withColumn("_last", last).where("_side = 1")
    return out.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def difference_stats(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Of consecutive differences by keys: sample deviation, mean, median and coefficient of variation."""
    diffs = df.withColumn("_d", F.col(value) - F.lag(value).over(W.partitionBy(*keys).orderBy(*order))).where("_d IS NOT NULL")
    return diffs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.stddev_samp("_d"), 6).alias("sd"), F.round(F.avg("_d"), 6).alias("mean"), F.round(F.percentile("_d", F.lit(0.5)), 6).alias("median"), F.round(F.try_divide(F.stddev_pop("_d"), F.avg("_d")), 6).alias("cv")
    )
