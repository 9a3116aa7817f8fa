"""Parameter sweeps: a grid, one pass over segments x grid, and a store that is read by grid point."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quantify import _split, quantify, rows_of

#: Grid points in a grid at most; a grid is broadcast.
MOST_POINTS = 100_000


def hash_parameters(dsp: dict[str, Any], prep: dict[str, Any] | None = None) -> str:
    """A digest that doesn't depend on the order of names."""
    return hashlib.md5(json.dumps({"dsp": dsp, "prep": prep or {}}, sort_keys=True).encode()).hexdigest()


def parameter_grid(spark: SparkSession, simulate: dict[str, list], prep: dict[str, list] | None = None) -> DataFrame:
    """(param_id, dsp, prep, param_hash): all combinations, the first name varying fastest; dsp and prep as JSON."""

    def points(values: dict[str, list]) -> list[dict]:
        if not values:
            return [{}]
        names = list(values)
        return [dict(zip(names, x[::-1], strict=True)) for x in itertools.product(*[values[n] for n in names[::-1]])]

    rows = [(d, p) for p in points(prep or {}) for d in points(simulate)] if simulate or prep else []
    if len(rows) > MOST_POINTS:
        raise ValueError(f"the grid has {len(rows)} points, over {MOST_POINTS}")
    rows = [(k, json.dumps(d, sort_keys=True), json.dumps(p, sort_keys=True), hash_parameters(d, p)) for k, (d, p) in enumerate(rows, 1)]
    return spark.createDataFrame(rows, "param_id int, dsp string, prep string, param_hash string")


def quantify_grid(found: DataFrame, grid: DataFrame, measure: Callable, schema: str, prepare: Callable | None = None) -> DataFrame:
    """Each segment measured at each grid point, with param_id and param_hash. prepare(segment, **prep) changes a segment first."""

    def at_point(row: dict):
        prep, dsp = json.loads(row["prep"]), json.loads(row["dsp"])
        segment = prepare(row, **prep) if prepare else row
        return measure(segment, **dsp)

    swept = found.crossJoin(F.broadcast(grid))
    keep = [*found.columns, "param_id", "param_hash", "dsp", "prep"]
    return quantify(swept, at_point, schema, columns=keep, by=("session", "bundle", "param_id")).drop("dsp", "prep")


def enrich_grid(files: DataFrame, grid: DataFrame, measure: Callable, schema: str) -> DataFrame:
    """Each file measured at each grid point: a track or an error."""
    inner = ", ".join(":".join(f.split(maxsplit=1)) for f in _split(schema))
    names = [f.split()[0] for f in _split(schema)]
    swept = files.crossJoin(F.broadcast(grid.select("param_id", "param_hash", "dsp")))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in swept.schema) + f", track array<struct<{inner}>>, error string"

    def run(frames):
        for pdf in frames:
            tracks, errors = [], []
            for row in pdf.to_dict("records"):
                try:
                    tracks.append(rows_of(measure(row, **json.loads(row["dsp"])))[names].to_dict("records"))
                    errors.append(None)
                except Exception as e:  # reported in the row
                    tracks.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(track=tracks, error=errors)

    return swept.mapInPandas(run, ddl).drop("dsp")


def save(results: DataFrame, grid: DataFrame, path: str, function: str, overwrite: bool = False) -> None:
    """Store results by grid point, with the grid and a row about the sweep."""
    mode = "overwrite" if overwrite else "errorifexists"
    grid.write.mode(mode).parquet(f"{path}/params")
    results.write.mode(mode).partitionBy("param_hash").parquet(f"{path}/results")
    grid.agg(F.lit(function).alias("function"), F.count("*").alias("n_points"), F.current_timestamp().alias("created")).write.mode(mode).parquet(f"{path}/meta")


def reminisce(spark: SparkSession, path: str, dsp: dict[str, Any], prep: dict[str, Any] | None = None) -> DataFrame:
    """Results of one grid point; its partition alone is read."""
    return spark.read.parquet(f"{path}/results").where(F.col("param_hash") == hash_parameters(dsp, prep))


def reminisce_tracks(spark: SparkSession, path: str, dsp: dict[str, Any], prep: dict[str, Any] | None = None, session: str | None = None, bundle: str | None = None) -> DataFrame:
    """Tracks of one grid point, of the sessions and bundles that match the patterns; a point that isn't stored is an error."""
    key = hash_parameters(dsp, prep)
    if spark.read.parquet(f"{path}/params").where(F.col("param_hash") == key).isEmpty():
        raise KeyError(f"no results for {dsp} in {path}")
    out = spark.read.parquet(f"{path}/results").where(F.col("param_hash") == key)
    for name, pattern in (("session", session), ("bundle", bundle)):
        out = out.where(F.col(name).rlike(pattern)) if pattern else out
    return out


META = "function string, n_points bigint, created timestamp"


def list_simulations(spark: SparkSession, folder: str) -> DataFrame:
    """(function, n_points, created, path) of the stores below folder; those without readable notes are passed over."""
    read = spark.read.schema(META).option("ignoreCorruptFiles", "true").option("pathGlobFilter", "*.parquet")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/meta")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where):
        return spark.createDataFrame([], f"{META}, path string")
    return read.parquet(f"{folder}/*/meta").withColumn("path", F.regexp_replace(F.col("_metadata.file_path"), r"/meta/[^/]*$", ""))


def assess_error(simulated: DataFrame, stored: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Root mean square error of each grid point against stored values, the best first in order of error."""
    pairs = simulated.select("param_id", *keys, F.col(value).alias("_a")).join(stored.select(*keys, F.col(value).alias("_b")), keys)
    return pairs.groupBy("param_id").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(F.col("_a") - F.col("_b"), 2))), 6).alias("rmse"))
