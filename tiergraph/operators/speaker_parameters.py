"""Measurement settings by age and gender, smoothed from studies' own settings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A study counts as at least so many speakers.
LEAST_SPEAKERS = 10
#: Later formants as multiples of the first; cycles of the lowest pitch, in milliseconds, in a window.
MULTIPLES = {"nominalF2": 3, "nominalF3": 5}
WINDOW_MS = 2000
UNSPECIFIED = "Unspecified"


def local_regression(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Weighted local parabolas over all points (span 1) with tricube distances; lines or means where points are few."""
    out = np.empty(len(at))
    for k, a in enumerate(at):
        distance = np.abs(x - a)
        reach = max(distance.max(), 1e-9) * (1 + 1e-9)
        weight = w * (1 - (distance / reach) ** 3) ** 3
        use = weight > 0
        degree = min(2, len(np.unique(x[use])) - 1)
        out[k] = np.polyval(np.polyfit(x[use] - a, y[use], degree, w=np.sqrt(weight[use])), 0) if use.any() else y.mean()
    return out


def smoothed(defaults: DataFrame) -> DataFrame:
    """(gender, age, parameter, setting) from studies (gender, age_lower, age_upper, parameter, setting, participants).

    Rows of either gender also count for Unspecified. A study weighs its speakers, for a lowest setting divided and for a
    highest one multiplied by the setting, so that the widest range weighs most. Rows without an age or setting are left out.
    """
    rows = defaults.where("setting IS NOT NULL AND age_lower IS NOT NULL AND age_upper >= age_lower")
    rows = rows.unionByName(rows.where(F.col("gender") != UNSPECIFIED).withColumn("gender", F.lit(UNSPECIFIED)))
    n = F.greatest(F.coalesce("participants", F.lit(0)), F.lit(LEAST_SPEAKERS))
    weight = F.when(F.col("parameter").startswith("min"), n / F.col("setting")).when(F.col("parameter").startswith("max"), n * F.col("setting")).otherwise(n)
    ages = F.explode(F.sequence(F.floor("age_lower").cast("int"), F.floor("age_upper").cast("int"))).alias("age")
    rows = rows.select("gender", "parameter", F.col("setting").cast("double").alias("setting"), weight.cast("double").alias("weight"), ages)
    # as many rows as a parameter has studies and ages; combined first where studies agree
    rows = rows.groupBy("gender", "parameter", "age", "setting").agg(F.sum("weight").alias("weight"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.arange(pdf["age"].min(), pdf["age"].max() + 1)
        pdf = pdf.sort_values(["age", "setting"])
        found = local_regression(pdf["age"].to_numpy(float), pdf["setting"].to_numpy(), pdf["weight"].to_numpy(), at.astype(float))
        return pd.DataFrame({"gender": pdf["gender"].iloc[0], "age": at.astype("int32"), "parameter": pdf["parameter"].iloc[0], "setting": found.round(9)})

    return rows.groupBy("gender", "parameter").applyInPandas(fit, "gender string, age int, parameter string, setting double")


def table(defaults: DataFrame, parameters: list[str], impute: bool = True) -> DataFrame:
    """A row per gender and age with a whole-numbered column per parameter.

    windowSize, nominalF2 and nominalF3 follow from minF and nominalF1 where no study has them. With impute, gaps between
    ages are filled along a line, and ends with the nearest value, where a gender has three values or more.
    """
    wide = smoothed(defaults).groupBy("gender", "age").pivot("parameter", parameters).agg(F.first("setting"))
    if "windowSize" in parameters and "minF" in parameters:
        wide = wide.withColumn("windowSize", F.coalesce("windowSize", F.ceil(F.lit(WINDOW_MS) / F.col("minF")).cast("double")))
    for name, times in MULTIPLES.items():
        if name in parameters and "nominalF1" in parameters:
            wide = wide.withColumn(name, F.coalesce(name, F.ceil(F.col("nominalF1") * times).cast("double")))
    wide = wide.withColumns({p: F.bround(p, 0) for p in parameters})
    if impute:
        by = W.partitionBy("gender")
        back, ahead = by.orderBy("age").rowsBetween(W.unboundedPreceding, 0), by.orderBy("age").rowsBetween(0, W.unboundedFollowing)
        filled = {}
        for p in parameters:
            point = F.when(F.col(p).isNotNull(), F.struct(F.col("age").alias("x"), F.col(p).alias("y")))
            a, b = F.last(point, ignorenulls=True).over(back), F.first(point, ignorenulls=True).over(ahead)
            line = F.when(a["x"] == b["x"], a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (F.col("age") - a["x"]) / (b["x"] - a["x"]))
            filled[p] = F.when(F.count(p).over(by) > 2, F.coalesce(F.col(p), line, a["y"], b["y"])).otherwise(F.col(p))
        wide = wide.withColumns(filled)
    return wide.select("gender", "age", *[F.col(p).cast("int").alias(p) for p in parameters])
