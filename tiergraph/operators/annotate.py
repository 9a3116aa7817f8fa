"""Annotators: user functions that propose annotations, run over all files at once, and what follows from their proposals.

An annotator is a function of a file's row (a dict) that gives start_time, end_time and label, times in milliseconds.
Audio isn't decoded here: rows carry the arrays (pitch, glottal pulses, intensity) that an annotator needs.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.prosody import pitch_targets, tones
from ..schemas import KEYS
from . import drafts, transcribe
from .quantify import asof, enrich

PROPOSED = "start_time double, end_time double, label string"
#: The tone labels.
TONES = ["M", "S", "T", "B", "H", "L", "U", "D"]


def annotate(files: DataFrame, annotator: Callable, parameters: dict[str, Any] | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, start_time, end_time, label, error): the proposals for every file, with its keys.

    A file that fails gives one row with the message in error, and the others go on; filter `error IS NULL` to skip it.
    """
    made = enrich(files, annotator, PROPOSED, parameters).select(*(keys or KEYS), F.explode_outer("track").alias("x"), "error")
    return made.where("x IS NOT NULL OR error IS NOT NULL").select(*(keys or KEYS), "x.*", "error")


def periods(row: dict, begin: float = 0.0, end: float = 0.0) -> pd.DataFrame:
    """An event at each glottal pulse, labelled with the intensity there (two digits, empty where there is none).

    row has pulses (seconds), and intensity with intensity_times, between which it is interpolated along a line. begin and
    end are seconds; 0 and 0 take the whole recording.
    """
    pulses = np.asarray(row["pulses"] if row["pulses"] is not None else [], float)
    if end > 0:
        pulses = pulses[(pulses >= begin) & (pulses <= end)]
    times, intensity = np.asarray(row["intensity_times"], float), np.asarray(row["intensity"], float)
    level = np.interp(pulses, times, intensity, np.nan, np.nan) if len(times) else np.full(len(pulses), np.nan)
    labels = ["" if np.isnan(x) else f"{x:.2f}" for x in level]
    return pd.DataFrame({"start_time": pulses * 1000, "end_time": pulses * 1000, "label": labels})


def tone_events(row: dict, **options) -> pd.DataFrame:
    """An event for each tone of the pitch contour in row["f0"], see functions.prosody."""
    found = tones(pitch_targets(row["f0"], **options) if row["f0"] is not None else [])["targets"]
    at = [x["time"] * 1000 for x in found]
    return pd.DataFrame({"start_time": at, "end_time": at, "label": [x["tone"] for x in found]})


def draft(corpus, files: DataFrame, annotator: Callable, level: str, kind: str = "EVENT", path: str | None = None, parameters: dict[str, Any] | None = None, force: bool = False, categories: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(suggestions, failures) for the bundles of the corpus that files has a row of; a bundle with two rows is an error.

    With path, what was drafted is kept there and only bundles without a successful draft are worked on; force drafts all
    of them again, and the newest draft of a bundle counts.
    """
    known = corpus.bundles.select("db_uuid", "session", F.col("name").alias("bundle"))
    files = files.join(known, KEYS, "left_semi")
    if twice := files.groupBy(*KEYS).count().where("count > 1").head(1):
        raise ValueError(f"{twice[0]} has several files")

    def run(rows: DataFrame) -> DataFrame:
        return enrich(rows, annotator, PROPOSED, parameters).select(*KEYS, F.lit(level).alias("level"), "track", "error")

    made = run(files) if path is None else drafts.resume(files, path, run, KEYS, force)
    rows = made.where("error IS NULL").select(*KEYS, F.explode("track").alias("x")).select(*KEYS, "x.*")
    return transcribe.suggestions(rows, level, kind, event_categories=categories), made.where("error IS NOT NULL").select(*KEYS, "error")


def draft_periods(corpus, files: DataFrame, level: str = "Period", **options) -> tuple[DataFrame, DataFrame]:
    return draft(corpus, files, periods, level, "EVENT", **options)


def draft_tones(corpus, files: DataFrame, level: str = "Intsint", **options) -> tuple[DataFrame, DataFrame]:
    return draft(corpus, files, tone_events, level, "EVENT", categories=TONES, **options)


def annotate_tones(corpus, files: DataFrame, level: str = "Intsint", force: bool = False, **options):
    """(corpus, log, failures): tones drafted, the level defined if need be, and the tones of sound bundles written."""
    proposed, failures = draft_tones(corpus, files, level, **options)
    corpus, log = transcribe.transcribe(transcribe.prepare(corpus, level, "EVENT"), proposed, force)
    return corpus, log, failures


def tone_summary(points: DataFrame, measures: DataFrame, keys: list[str], values: list[str], duration: DataFrame) -> DataFrame:
    """One row a recording: how its tones follow each other.

    points has keys, t and tone; measures has keys, t and values, each point taking the last at or before it; duration has
    keys and seconds. Points that lack a value are left out. For each value: sample deviation, mean, median and coefficient
    of variation of the differences between consecutive points; then the number of tones, of different ones, and of tones
    a second. Recordings without points give no row; one difference has no deviation (null).
    """
    order = W.partitionBy(*keys).orderBy("t", "tone")
    rows = asof(points, measures, keys, "t", "t", values).dropna(subset=values)
    steps = rows.select("*", *[(F.col(v) - F.lag(v).over(order)).alias(f"_{v}") for v in values])
    of = {"stdev": F.stddev_samp, "mean": F.avg, "median": lambda d: F.percentile(d, F.lit(0.5)), "variation": lambda d: F.try_divide(F.stddev_pop(d), F.avg(d))}
    stats = [F.round(stat(F.col(f"_{v}")), 6).alias(f"{v}_diff_{name}") for v in values for name, stat in of.items()]
    out = steps.groupBy(*keys).agg(*stats, F.count("*").alias("n_tones"), F.countDistinct("tone").alias("n_different"))
    return out.join(duration, keys, "left").withColumn("tones_per_second", F.round(F.try_divide(F.col("n_tones"), F.col("seconds")), 6))
