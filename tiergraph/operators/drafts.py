"""Stores of computed drafts and measurements: resumable work, summaries, eviction and clean-up."""

from __future__ import annotations

import datetime as dt
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes from which a store is reported, and from which it is full, by kind.
LIMITS = {"quantify": (500 * 1024**2, 2 * 1024**3), "simulation": (1024**3, 5 * 1024**3), "draft": (500 * 1024**2, 2 * 1024**3)}


def draft_path(root: str, function: str, day: dt.date) -> str:
    return f"{root}/{re.sub('^draft_', '', function)}/date={day:%Y%m%d}"


def pending(bundles: DataFrame, done: DataFrame | None, keys: tuple[str, ...] | list[str] = ("session", "bundle")) -> DataFrame:
    """Bundles that have no successful draft yet."""
    return bundles if done is None else bundles.join(done.where("error IS NULL").select(*keys).distinct(), list(keys), "left_anti")


def latest(rows: DataFrame, keys: list[str], order: str = "created_at") -> DataFrame:
    """The newest row of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(order, *[c for c in rows.columns if c != order])).alias("_r")).select("_r.*")


def _there(spark: SparkSession, path: str):
    """The file system and path, and whether there is anything."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, where, fs.exists(where)


def resume(bundles: DataFrame, path: str, draft: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] | list[str] = ("session", "bundle"), force: bool = False) -> DataFrame:
    """Draft the bundles that the store at path lacks, append them, and give all drafts, the newest of each bundle.

    force drafts all of them again. A run that fails appends nothing, as Spark commits whole jobs.
    """
    spark = bundles.sparkSession
    done = spark.read.parquet(path) if _there(spark, path)[2] and not force else None
    draft(pending(bundles, done, keys)).withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)
    return latest(spark.read.parquet(path), list(keys))


#: Marks a store in which every bundle was drafted.
COMPLETED = "_completed"


def mark_completed(spark: SparkSession, path: str) -> None:
    """Note in the store that all its bundles are drafted; readers of Parquet pass over the note."""
    fs, where, _ = _there(spark, f"{path}/{COMPLETED}")
    fs.create(where, True).close()


def draft_stores(spark: SparkSession, root: str, function: str | None = None) -> list[dict]:
    """function, date, path and completed of each store below root (draft_path()), the newest first, then by name."""
    name = re.sub("^draft_", "", function) if function else "*"
    fs, where, _ = _there(spark, f"{root}/{name}/date=*")
    out = []
    for x in fs.globStatus(where) or []:
        path, day = x.getPath().toString(), x.getPath().getName().split("=")[1]
        if re.fullmatch(r"\d{8}", day):
            out.append({"function": x.getPath().getParent().getName(), "date": dt.datetime.strptime(day, "%Y%m%d").date(), "path": path, "completed": _there(spark, f"{path}/{COMPLETED}")[2]})
    return sorted(out, key=lambda x: (-x["date"].toordinal(), x["function"]))


def list_drafts(spark: SparkSession, root: str, bundles: DataFrame, keys: tuple[str, ...] | list[str] = ("session", "bundle")) -> DataFrame:
    """A row per store: function, date, path, completed, first and last draft, and how many of the bundles have one."""
    n_total = F.broadcast(bundles.select(*keys).distinct().agg(F.count("*").alias("n_total")))  # one row
    schema = "function string, date date, path string, completed boolean, created_at timestamp, last_updated timestamp, n_completed bigint, n_total bigint"
    out = spark.createDataFrame([], schema)
    for store in draft_stores(spark, root):
        rows = spark.read.parquet(store["path"])
        good = F.when(F.col("error").isNull(), F.struct(*keys))
        row = rows.agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("last_updated"), F.countDistinct(good).alias("n_completed")).crossJoin(n_total)
        head = [F.lit(store[c]).alias(c) for c in ("function", "date", "path", "completed")]
        out = out.unionByName(row.select(*head, "created_at", "last_updated", "n_completed", "n_total"))
    return out


def draft_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.col("error").isNull().cast("bigint")).alias("n_done"), F.sum(F.col("error").isNotNull().cast("bigint")).alias("n_failed"))


def evict(cache: DataFrame, max_bytes: int, share: int = 4) -> DataFrame:
    """cache without its least recently used quarter of rows, if it is larger than max_bytes in all.

    The quarter is cut at a quantile of accessed_at, exact to one row in 10,000; rows of one time go together.
    """
    used = F.col("accessed_at").cast("double")
    # one row
    cut = cache.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("_bytes"), F.percentile_approx(used, 1 / share, 10_000).alias("_cut"))
    kept = cache.crossJoin(F.broadcast(cut)).where((F.col("_bytes") <= max_bytes) | used.isNull() | (used > F.col("_cut")))
    return kept.drop("_bytes", "_cut")


def cache_summary(cache: DataFrame) -> DataFrame:
    return cache.groupBy("format").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def without_older(cache: DataFrame, before, fmt: str | None = None) -> DataFrame:
    old = F.col("created_at") < F.lit(before)
    return cache.where(~(old & (F.col("format") == fmt) if fmt else old))


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, modified) of files below a folder, the largest first; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).orderBy(F.desc("bytes"), "path")


def status(folder: str, kind: str) -> dict:
    """Size of a local store against its limits."""
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)
    warn, most = LIMITS[kind]
    return {"kind": kind, "bytes": size, "status": "full" if size > most else "large" if size > warn else "ok"}


def remove_old(folder: str, days: int = 30, pattern: str = r".*", dry_run: bool = True, today: dt.datetime | None = None) -> list[str]:
    """Local files older than days whose name matches; deleted unless dry_run."""
    now = (today or dt.datetime.now()).timestamp()
    old = [p for d, _, names in os.walk(folder) for f in names if re.search(pattern, f) and now - os.path.getmtime(p := os.path.join(d, f)) > days * 86400]
    for p in [] if dry_run else old:
        os.remove(p)
    return sorted(old)


def manage(folders: dict[str, str], action: str = "status", kind: str = "all", days: int = 30, dry_run: bool = True, today: dt.datetime | None = None) -> list:
    """What is to be known or done about local stores: folders are by kind (quantify, simulation, draft).

    status: a dict for each store; list: (kind, path, bytes) of its files, the largest first; clean: paths of files older
    than days, deleted only with dry_run=False.
    """
    if action not in ("status", "list", "clean"):
        raise ValueError(f"no action {action}")
    if kind != "all" and kind not in LIMITS:
        raise ValueError(f"no kind of store {kind}")
    if days < 1:
        raise ValueError("days is at least 1")
    chosen = {k: v for k, v in folders.items() if kind in ("all", k)}
    if action == "status":
        return [status(v, k) for k, v in chosen.items()]
    if action == "clean":
        return sorted(p for v in chosen.values() for p in remove_old(v, days, dry_run=dry_run, today=today))
    found = [(k, p, os.path.getsize(p)) for k, v in chosen.items() for d, _, names in os.walk(v) for p in (os.path.join(d, f) for f in names)]
    return sorted(found, key=lambda x: (-x[2], x[1]))
