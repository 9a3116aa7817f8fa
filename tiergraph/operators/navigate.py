"""From segments to other items: along a level, up and down the hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compile import as_nodes, segments
from ..schemas import KEYS


def scout(corpus, found: DataFrame, steps: int, count_from: str = "START", capture: int = 1, across_bundles: bool = False) -> DataFrame:
    """The items `steps` after each segment on its level; with capture > 1 a span of so many, as far as they go.

    Segments without an item there are dropped. Across bundles, positions are matched in any bundle of the session,
    and the first bundle by name is taken.
    """
    if count_from not in ("START", "END"):
        raise ValueError("count_from is START or END")
    if capture < 1:
        raise ValueError("capture is at least 1")
    reference = F.col("start_item_seq_idx") if count_from == "START" else F.col("end_item_seq_idx")
    keys = ["db_uuid", "session"] + ([] if across_bundles else ["bundle"])
    own = ["db_uuid", "session", "bundle", "level", "start_item_id", "end_item_id"]
    wanted = found.select(*[F.col(c).alias("_" + c) for c in own], (reference + steps).alias("_first")).distinct()
    # positions are listed, so that the range becomes an equality
    wanted = wanted.withColumn("_seq", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.lit(capture - 1))))
    targets = corpus.nodes
    if across_bundles:
        # the first bundle at each position, so that a segment meets one row for each of its positions and not every bundle
        firsts = corpus.items.groupBy(F.col("db_uuid").alias("_db_uuid"), F.col("session").alias("_session"), F.col("level").alias("_level"), F.col("seq_idx").alias("_seq")).agg(F.min("bundle").alias("_target"))
        at = ["_db_uuid", "_session", "_level", "_seq"]
        target = wanted.join(firsts, at).groupBy(*["_" + c for c in own]).agg(F.min("_target").alias("_target"))
        wanted = wanted.join(target, ["_" + c for c in own])
    on = [targets[k] == wanted["_" + k] for k in (*keys, "level")] + [targets["seq_idx"] == wanted["_seq"]]
    if across_bundles:
        on.append(targets["bundle"] == wanted["_target"])
    met = targets.join(wanted, on)
    group = ["_" + c for c in own]
    item = F.struct("seq_idx", "bundle", "item_id", "type", "sample_start", "sample_end", "sample_rate", F.coalesce("label", F.lit("")).alias("label"))
    spans = met.groupBy(*group).agg(F.array_sort(F.collect_set(item)).alias("all"))
    first, last = F.col("all")[0], F.element_at("all", -1)
    return spans.select(
        F.array_join(F.transform("all", lambda x: x["label"]), " ").alias("labels"),
        (first["sample_start"] / first["sample_rate"] * 1000).alias("start"),
        (last["sample_end"] / last["sample_rate"] * 1000).alias("end"),
        F.col("_db_uuid").alias("db_uuid"),
        F.col("_session").alias("session"),
        first["bundle"].alias("bundle"),
        first["item_id"].alias("start_item_id"),
        last["item_id"].alias("end_item_id"),
        F.col("_level").alias("level"),
        F.col("_level").alias("attribute"),
        first["seq_idx"].alias("start_item_seq_idx"),
        last["seq_idx"].alias("end_item_seq_idx"),
        first["type"].alias("type"),
        first["sample_start"].alias("sample_start"),
        last["sample_end"].alias("sample_end"),
        first["sample_rate"].alias("sample_rate"),
    )


def retreat(corpus, found: DataFrame, steps: int, **options) -> DataFrame:
    """scout() backwards."""
    return scout(corpus, found, -abs(steps), **options)


def _climb(corpus, found: DataFrame, level: str, up: bool) -> DataFrame:
    if not corpus.hierarchy.level(level):
        raise ValueError(f"no level {level}")
    compiler = corpus.compiler()
    out = None
    # a segment list may hold several levels; each has a way of its own
    for x in corpus.hierarchy.levels:
        way = corpus.hierarchy.path(level, x.name) if up else corpus.hierarchy.path(x.name, level)
        if way is None or len(way) < 2:
            continue
        ids = found.where(F.col("level") == x.name).select(*KEYS, F.col("start_item_id").alias("item_id")).distinct()
        ids = compiler.reach(ids, way, up)
        out = ids if out is None else out.unionByName(ids)
    if out is None:
        raise ValueError(f"no way to {level}")
    items = corpus.nodes.where(F.col("level") == level).join(out, [*KEYS, "item_id"], "left_semi")
    return segments(as_nodes(items, F.lit(level)))


def ascend_to(corpus, found: DataFrame, level: str) -> DataFrame:
    """The distinct items of a level above that segments (by their first item) are linked with, over any number of links."""
    return _climb(corpus, found, level, True)


def descend_to(corpus, found: DataFrame, level: str) -> DataFrame:
    """The distinct items of a level below that segments (by their first item) are linked with."""
    return _climb(corpus, found, level, False)
