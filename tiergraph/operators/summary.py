"""Counts and statistics of corpora and segment lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import KEYS


def corpus_counts(corpus) -> DataFrame:
    """(what, n) for sessions, bundles, items, labels and links."""
    sessions = corpus.bundles.select("db_uuid", "session").distinct()
    out = None
    for what, table in (("bundles", corpus.bundles), ("items", corpus.items), ("labels", corpus.labels), ("links", corpus.links), ("sessions", sessions)):
        row = table.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def level_counts(corpus) -> DataFrame:
    return corpus.items.groupBy("level", "type").agg(F.count("*").alias("n_items"), F.countDistinct("session", "bundle").alias("n_bundles"))


def segment_stats(found: DataFrame) -> DataFrame:
    """One row: distinct values and the spread of durations in milliseconds."""
    duration = F.col("end") - F.col("start")
    return found.agg(
        F.count("*").alias("n"),
        F.countDistinct("labels").alias("n_labels"),
        F.countDistinct("session").alias("n_sessions"),
        F.countDistinct("session", "bundle").alias("n_bundles"),
        F.min(duration).alias("min_ms"),
        F.max(duration).alias("max_ms"),
        F.round(F.avg(duration), 6).alias("mean_ms"),
        F.percentile(duration, F.lit(0.5)).alias("median_ms"),
        F.sum(duration).alias("total_ms"),
    )


def top_labels(found: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent labels with their share in percent; ties in order of the label."""
    counts = found.groupBy("labels").agg(F.count("*").alias("n"))
    total = found.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("labels", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent")).orderBy(F.desc("n"), "labels").limit(n)


def per_session(found: DataFrame) -> DataFrame:
    """Segments per session: mean, least and most, over sessions with any."""
    counts = found.groupBy("session").agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("sessions"), F.round(F.avg("n"), 6).alias("mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"))


def measure_stats(extended: DataFrame, measures: list[str]) -> DataFrame:
    """Per measure: n, missing, min, max, mean and sample standard deviation."""
    stacked = extended.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])).alias("x")).select("x.*")
    return stacked.groupBy("measure").agg(
        F.count("value").alias("n"), F.sum(F.col("value").isNull().cast("bigint")).alias("missing"), F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd")
    )


def rows_per_segment(extended: DataFrame) -> DataFrame:
    return extended.groupBy(*KEYS, "start_item_id").agg(F.count("*").alias("n"))


def glimpse(corpus, labels: int = 5) -> DataFrame:
    """(db_uuid, level, type, n_items, n_labels, examples): the levels in use, each with its first labels by name."""
    own = corpus.nodes.groupBy("db_uuid", "level", "type", "label").agg(F.count("*").alias("n"))
    # a level keeps its first labels only, part by part
    first = F.expr(f"slice(array_sort(collect_set(label)), 1, {labels})")
    ranked = own.withColumn("_part", F.pmod(F.xxhash64("label"), F.lit(64)))
    parts = ranked.groupBy("db_uuid", "level", "type", "_part").agg(F.sum("n").alias("n"), F.count("label").alias("n_labels"), first.alias("x"))
    whole = F.slice(F.array_sort(F.flatten(F.collect_list("x"))), 1, labels)
    return parts.groupBy("db_uuid", "level", "type").agg(F.sum("n").alias("n_items"), F.sum("n_labels").alias("n_labels"), whole.alias("examples"))


def overview(found: DataFrame) -> DataFrame:
    """A row for each column of a result: its type, how many rows have it, and how many values it has (approximately)."""
    fields = [f for f in found.schema]
    counts = found.agg(F.count("*").alias("_rows"), *[F.struct(F.count(f"`{f.name}`").alias("n"), F.approx_count_distinct(F.to_json(F.struct(f"`{f.name}`"))).alias("n_values")).alias(f"_{k}") for k, f in enumerate(fields)])
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("_rows").alias("rows"), F.col(f"_{k}.n").alias("n"), F.col(f"_{k}.n_values").alias("n_values")) for k, f in enumerate(fields)]
    return counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def bundle_overview(bundles: DataFrame, fields: list[str]) -> DataFrame:
    """Per session of a bundle list: bundles, and how many have a value in each field."""
    return bundles.groupBy("db_uuid", "session").agg(F.count("*").alias("n_bundles"), *[F.count(f"`{f}`").alias(f"n_{f}") for f in fields])


def plan_of(found: DataFrame) -> dict:
    """What a lazy result is before it runs: its columns, and the joins, exchanges and scans of its plan."""
    text = found._jdf.queryExecution().executedPlan().toString()
    return {"columns": found.columns, "joins": text.count("Join "), "exchanges": text.count("Exchange "), "scans": text.count("FileScan")}
