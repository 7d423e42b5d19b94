"""Lag features of each series, all from one window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outbreak_spark.model import KEYS, ORDER, series


def feature_names(n_lags: int = 14) -> list[str]:
    rolling = [f"rolling_{d}d_{k}" for d in (7, 14) for k in ("mean", "std", "min", "max")]
    return [*(f"lag_{k}" for k in range(1, n_lags + 1)), *rolling, "day_change", "week_change_ratio", "day_of_week", "month", "is_weekend"]


def lag_features(df: DataFrame, n_lags: int = 14, column: str = "new_cases") -> DataFrame:
    """keys, record_index, date, features, target, of records with n_lags before them. Rolling values are of the records
    before; a deviation of one value is 0; a week's ratio over nothing is 1."""
    w = series()
    x = F.col(column).cast("double")
    lag = lambda k: F.lag(x, k).over(w)
    cols = [lag(k).alias(f"lag_{k}") for k in range(1, n_lags + 1)]
    for d in (7, 14):
        last = w.rowsBetween(-d, -1)
        cols += [F.avg(x).over(last).alias(f"rolling_{d}d_mean"), F.coalesce(F.stddev_samp(x).over(last), F.lit(0.0)).alias(f"rolling_{d}d_std"), F.min(x).over(last).alias(f"rolling_{d}d_min"), F.max(x).over(last).alias(f"rolling_{d}d_max")]
    cols.append((lag(1) - lag(2)).alias("day_change"))
    cols.append(F.when(lag(7) > 0, lag(1) / F.when(lag(7) > 0, lag(7))).otherwise(1.0).alias("week_change_ratio"))
    day = F.col("date").cast("date")
    cols += [F.weekday(day).alias("day_of_week"), F.month(day).alias("month"), F.when(F.weekday(day) >= 5, 1).otherwise(0).alias("is_weekend")]
    out = df.select(*KEYS, ORDER, "date", *cols, x.alias("target"), F.row_number().over(w).alias("__n"))
    return out.where((F.col("__n") > n_lags) & F.col("target").isNotNull()).drop("__n").na.drop(subset=[f"lag_{k}" for k in range(1, n_lags + 1)])
