"""What drives a forecast: Shapley values of the boosted trees, by feature and over time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outbreak_spark.kernels.trees import Booster
from outbreak_spark.model import KEYS, ORDER
from outbreak_spark.operators.features import feature_names


def _names() -> dict[str, str]:
    """What features are called in reports."""
    out = {f"lag_{k}": f"new cases {k} day{'s' * (k > 1)} earlier" for k in range(1, 31)}
    for d in (7, 14):
        for key, text in (("mean", "mean"), ("std", "spread"), ("min", "lowest count"), ("max", "highest count")):
            out[f"rolling_{d}d_{key}"] = f"{text} of the last {d} days"
    return out | {"day_change": "latest change from day to day", "week_change_ratio": "latest count against that of a week before", "day_of_week": "weekday", "month": "calendar month", "is_weekend": "Saturday or Sunday"}


NAMES = _names()
PHI = "region string, pathogen string, row int, feature string, phi double, prediction double, base double"


def shapley_values(features: DataFrame, n_lags: int = 14, trees: int = 200) -> DataFrame:
    """Long: row (0, 1, ... by record), feature, phi, prediction, base. A series' phi and base add up to its prediction.
    The model learns from all of a series' rows, without sampling. One task per series."""
    names = feature_names(n_lags)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORDER)
        x, y = pdf[names].to_numpy(float), pdf.target.to_numpy(float)
        model = Booster(trees=trees, depth=6, rows=1.0, features=1.0, least=1).fit(x, y)
        phi = model.shapley(x)
        n, m = x.shape
        return pd.DataFrame({"region": key[0], "pathogen": key[1], "row": np.repeat(np.arange(n, dtype=np.int32), m), "feature": np.tile(np.array(names, object), n), "phi": phi.ravel(), "prediction": np.repeat(model.predict(x), m), "base": model.expected()})

    return features.select(*KEYS, ORDER, *names, "target").groupBy(*KEYS).applyInPandas(run, PHI)


def label(feature):
    """The feature's name in reports, itself if it has none."""
    names = F.create_map(*(F.lit(v) for kv in NAMES.items() for v in kv))
    return F.coalesce(names[feature], feature)


def drivers(phi: DataFrame, k: int = 10) -> DataFrame:
    """Each series' k features of largest mean absolute phi, ties in order of name."""
    mean = phi.groupBy(*KEYS, "feature").agg(F.avg(F.abs("phi")).alias("importance"))
    w = Window.partitionBy(*KEYS).orderBy(F.desc("importance"), "feature")
    return mean.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("label", label(F.col("feature")))


def importance_drivers(series: DataFrame, weights: dict[str, float], k: int = 10) -> DataFrame:
    """drivers() where there are no Shapley values: a model's importances, alike for each series it serves; ties in order of
    name. Without weights, no rows."""
    top = sorted(weights.items(), key=lambda w: (-w[1], w[0]))[:k]
    rows = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(float(v)).alias("importance"), F.lit(rank).alias("rank")) for rank, (f, v) in enumerate(top, 1)))
    if not top:
        rows = F.array().cast("array<struct<feature:string,importance:double,rank:int>>")
    return series.select(*KEYS).distinct().select(*KEYS, F.explode(rows).alias("r")).select(*KEYS, "r.*").withColumn("label", label(F.col("feature")))


def time_buckets(phi: DataFrame, buckets: int = 4, least: int = 20) -> DataFrame:
    """Mean absolute phi by feature and quarter of the rows (what is left over goes to the last), of series with at
    least so many rows."""
    n = F.max("row").over(Window.partitionBy(*KEYS)) + 1
    x = phi.withColumn("n", n).where(F.col("n") >= least)
    at = F.least(F.floor(F.col("row") / F.floor(F.col("n") / buckets)), F.lit(buckets - 1)).cast("int")
    return x.groupBy(*KEYS, at.alias("bucket"), "feature").agg(F.avg(F.abs("phi")).alias("importance"))


def trends(buckets: DataFrame) -> DataFrame:
    """Per feature whether the last of the last three buckets is above the first of them."""
    w = Window.partitionBy(*KEYS, "feature").orderBy(F.desc("bucket"))
    last = buckets.withColumn("__r", F.row_number().over(w)).where("__r <= 3")
    return last.groupBy(*KEYS, "feature").agg(F.when(F.max_by("importance", "bucket") > F.min_by("importance", "bucket"), "increasing").otherwise("decreasing").alias("trend"))


def narrative(top: DataFrame, lines: int = 5) -> DataFrame:
    """A short text per series."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("label"), F.lit(" ("), F.format_number("importance", 2), F.lit(")"))
    rows = top.where(F.col("rank") <= lines).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("x"))
    return rows.select(*KEYS, F.concat(F.lit("Main drivers:\n"), F.array_join(F.transform("x", lambda r: r["l"]), "\n")).alias("narrative"))
