"""Proposed annotations: checks, and writing them into a corpus as new tables. All bundles at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import to_samples
from ..plans.hierarchy import Level
from ..schemas import KEYS

ERRORS = ("overlap", "outside", "reversed", "no_bundle", "no_level", "wrong_type")
WARNINGS = ("short", "existing", "empty")


def suggestions(df: DataFrame, level: str, kind: str = "SEGMENT", attribute: str | None = None, unit: str = "ms", remove_empty: bool = False, event_categories: list[str] | None = None) -> DataFrame:
    """(db_uuid, session, bundle, level, attribute, type, start_time, end_time, label, confidence), times in milliseconds.

    Events end where they start. Labels outside event_categories are errors that the caller sees at once.
    """
    factor = {"ms": 1.0, "s": 1000.0}[unit]
    end = F.col("end_time") if "end_time" in df.columns and kind != "EVENT" else F.col("start_time")
    out = df.select(
        *KEYS, F.lit(level).alias("level"), F.lit(attribute or level).alias("attribute"), F.lit(kind).alias("type"), (F.col("start_time") * factor).alias("start_time"), (end * factor).alias("end_time"), F.coalesce("label", F.lit("")).alias("label"),
        (F.col("confidence") if "confidence" in df.columns else F.lit(None)).cast("double").alias("confidence"),
    )
    if remove_empty:
        out = out.where("label != ''")
    if event_categories is not None and not out.where(~F.col("label").isin(*event_categories)).isEmpty():
        raise ValueError("a label is in none of the categories")
    return out


def problems(corpus, suggested: DataFrame, min_ms: float = 10.0) -> DataFrame:
    """(db_uuid, session, bundle, level, start_time, end_time, label, problem, is_error): a row per problem."""
    names = [*KEYS, "level", "start_time", "end_time", "label"]
    order = W.partitionBy(*KEYS, "level").orderBy("start_time", "end_time")
    levels = corpus.peek("levels").select(F.col("name").alias("level"), F.col("type").alias("level_type"))
    bundles = corpus.bundles.select("db_uuid", "session", F.col("name").alias("bundle"), F.lit(True).alias("known"))
    end = F.max((F.coalesce("sample_start", "sample_point") + F.coalesce("sample_dur", F.lit(0))) / F.col("sample_rate") * 1000)
    last = corpus.items.groupBy(*KEYS).agg(end.alias("bundle_ms"))
    have = corpus.items.groupBy(*KEYS, "level").agg(F.count("*").alias("n_items"))
    rows = suggested.withColumn("next_start", F.lead("start_time").over(order)).join(F.broadcast(levels), "level", "left")
    rows = rows.join(bundles, KEYS, "left").join(last, KEYS, "left").join(have, [*KEYS, "level"], "left")
    length = F.col("end_time") - F.col("start_time")
    tests = {
        "overlap": F.col("end_time") > F.col("next_start"),
        "outside": (F.col("start_time") < 0) | (F.col("end_time") > F.col("bundle_ms")),
        "reversed": length < 0,
        "no_bundle": F.col("known").isNull(),
        "no_level": F.col("level_type").isNull(),
        "wrong_type": F.col("level_type") != F.col("type"),
        "short": (F.col("type") == "SEGMENT") & (length >= 0) & (length < min_ms),
        "existing": F.col("n_items") > 0,
        "empty": F.col("label") == "",
    }
    found = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())
    return rows.select(*names, F.explode(found).alias("problem")).withColumn("is_error", F.col("problem").isin(*ERRORS))


def assess(corpus, suggested: DataFrame, min_ms: float = 10.0) -> DataFrame:
    """Per bundle and level: errors, warnings and whether it can be written."""
    found = problems(corpus, suggested, min_ms)
    n = suggested.groupBy(*KEYS, "level").agg(F.count("*").alias("n"))
    counts = found.groupBy(*KEYS, "level").agg(F.sum(F.col("is_error").cast("bigint")).alias("n_errors"), F.sum((~F.col("is_error")).cast("bigint")).alias("n_warnings"))
    out = n.join(counts, [*KEYS, "level"], "left").na.fill(0, ["n_errors", "n_warnings"])
    return out.withColumn("can_transcribe", F.col("n_errors") == 0)


def correct(suggested: DataFrame, at: DataFrame, **changes) -> DataFrame:
    """suggested with the columns changed in rows whose keys, level and start_time are in at."""
    keys = [*KEYS, "level", "start_time"]
    marked = suggested.join(at.select(*keys).distinct().withColumn("_at", F.lit(True)), keys, "left")
    for name, value in changes.items():
        marked = marked.withColumn(name, F.when(F.col("_at"), F.lit(value)).otherwise(F.col(name)))
    return marked.drop("_at").select(*suggested.columns)


def prepare(corpus, level: str, kind: str):
    """The corpus with the level defined, if it isn't."""
    known = corpus.hierarchy.level(level)
    if known and known.type != kind:
        raise ValueError(f"level {level} is {known.type}, not {kind}")
    return corpus if known else corpus.replace(hierarchy=corpus.hierarchy.with_level(Level(level, kind)))


def numbered(corpus, suggested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New items and labels: ids go on from each bundle's largest, positions in order of time after those of the level."""
    last = corpus.items.groupBy(*KEYS).agg(F.max("item_id").alias("last_id"))
    there = corpus.items.groupBy(*KEYS, "level").agg(F.max("seq_idx").alias("last_seq"))
    rate = corpus.bundles.select("db_uuid", "session", F.col("name").alias("bundle"), "sample_rate")
    by_bundle = W.partitionBy(*KEYS).orderBy("level", "start_time", "end_time", "label")
    by_level = W.partitionBy(*KEYS, "level").orderBy("start_time", "end_time", "label")
    rows = suggested.withColumn("_id", F.row_number().over(by_bundle)).withColumn("_seq", F.row_number().over(by_level))
    rows = rows.join(rate, KEYS).join(last, KEYS, "left").join(there, [*KEYS, "level"], "left")
    start, end = to_samples(F.col("start_time"), F.col("sample_rate")), to_samples(F.col("end_time"), F.col("sample_rate"))
    event, timed = F.col("type") == "EVENT", F.col("type") == "SEGMENT"
    rows = rows.withColumn("item_id", F.col("_id") + F.coalesce("last_id", F.lit(0))).withColumn("seq_idx", (F.col("_seq") + F.coalesce("last_seq", F.lit(0))).cast("int"))
    items = rows.select(*KEYS, "item_id", "level", "type", "seq_idx", "sample_rate", F.when(event, start).alias("sample_point"), F.when(timed, start).alias("sample_start"), F.when(timed, end - start).alias("sample_dur"))
    labels = rows.select(*KEYS, "item_id", F.lit(1).alias("label_idx"), F.col("attribute").alias("name"), "label")
    return items, labels


@dataclass(frozen=True)
class Log:
    """What transcribe() added: (db_uuid, session, bundle, item_id), so that it can be taken back."""

    added: DataFrame

    def counts(self) -> DataFrame:
        return self.added.groupBy(*KEYS).agg(F.count("*").alias("n_items_added"), F.current_timestamp().alias("at"))


def transcribe(corpus, suggested: DataFrame, force: bool = False):
    """(corpus, log) with the suggestions of bundles and levels without errors written; force takes all."""
    if not force:
        fit = assess(corpus, suggested).where("can_transcribe").select(*KEYS, "level")
        suggested = suggested.join(fit, [*KEYS, "level"], "left_semi")
    items, labels = numbered(corpus, suggested)
    out = corpus.replace(items=corpus.items.unionByName(items), labels=corpus.labels.unionByName(labels))
    return out, Log(items.select(*KEYS, "item_id"))


def reverse(corpus, log: Log):
    """The corpus without what the log says was added, and links to it."""
    gone, on = log.added, [*KEYS, "item_id"]
    links = corpus.links
    for end in ("from_id", "to_id"):
        links = links.join(gone.select(*KEYS, F.col("item_id").alias(end)), [*KEYS, end], "left_anti")
    return corpus.replace(items=corpus.items.join(gone, on, "left_anti"), labels=corpus.labels.join(gone, on, "left_anti"), links=links.select(*corpus.links.columns))
