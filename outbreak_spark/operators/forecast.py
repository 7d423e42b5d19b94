"""Forecasts of each series by boosted trees on lag features and by a weekly trend, and their ensemble."""

from __future__ import annotations

import datetime
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outbreak_spark.kernels.trees import Booster
from outbreak_spark.model import KEYS, ORDER
from outbreak_spark.operators.features import feature_names

LEAST_ROWS = 24
FORECAST = "region string, pathogen string, model string, step int, date date, predicted double, lower double, upper double, rmse double, mae double, importance map<string,double>"


def next_row(history: np.ndarray, date: datetime.date, n_lags: int) -> list[float]:
    """Features of the day after a history, as lag_features has them."""
    rolled = []
    for d in (7, 14):
        x = history[-d:]
        rolled += [x.mean(), x.std(ddof=1) if len(x) > 1 else 0.0, x.min(), x.max()]
    ratio = history[-1] / history[-7] if history[-7] > 0 else 1.0
    return [*history[-1 : -n_lags - 1 : -1], *rolled, history[-1] - history[-2], ratio, date.weekday(), date.month, float(date.weekday() >= 5)]


def table(x: np.ndarray, dates: list, n_lags: int) -> np.ndarray:
    return np.array([next_row(x[:k], dates[k], n_lags) for k in range(n_lags, len(x))], float).reshape(-1, n_lags + 13)


def _trees(x, dates, horizon, n_lags, test):
    rows, target = table(x, dates, n_lags), x[n_lags:]
    model = Booster().fit(rows[:-test], target[:-test])
    off = target[-test:] - model.predict(rows[-test:])
    history, out = x.copy(), []
    for k in range(1, horizon + 1):
        day = dates[-1] + datetime.timedelta(days=k)
        y = max(0.0, float(model.predict(np.array([next_row(history, day, n_lags)], float))[0]))
        history = np.append(history, y)
        out.append(y)
    names = feature_names(n_lags)
    weight = model.importance(len(names))
    top = sorted(range(len(names)), key=lambda k: (-weight[k], k))[:15]
    return np.array(out), off, {names[k]: float(weight[k]) for k in top}


def _weekly(x, dates, horizon, n_lags, test):
    def fit(x, dates, ahead):
        t = np.arange(len(x), dtype=float)
        w = 0.98 ** (len(x) - 1 - t)  # late days weigh more
        slope, level = np.polyfit(t, x, 1, w=np.sqrt(w))
        line = np.maximum(level + slope * t, 1e-9)
        days = np.array([d.weekday() for d in dates])
        factor = np.array([np.average((x / line)[days == d], weights=w[days == d]) if (days == d).any() else 1.0 for d in range(7)])
        future = len(x) + np.arange(ahead)
        wanted = [(dates[-1] + datetime.timedelta(days=k + 1)).weekday() for k in range(ahead)]
        return np.maximum((level + slope * future) * factor[wanted], 0.0)

    off = x[-test:] - fit(x[:-test], dates[:-test], test)
    return fit(x, dates, horizon), off, {}


MODELS: dict[str, Callable] = {"trees": _trees, "weekly": _weekly}


def forecast(df: DataFrame, horizon: int = 14, n_lags: int = 14, test_size: int = 14, models: tuple[str, ...] = ("trees", "weekly")) -> DataFrame:
    """A row per series, model and step: date, predicted, lower, upper (1.96 deviations of the validation errors, 0 at
    least), rmse, mae, importance. The last test_size rows validate. Series with fewer than LEAST_ROWS feature rows give
    none. One task per series: only four columns travel."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORDER)
        x, dates = pdf.new_cases.to_numpy(float), list(pdf.date)
        out = []
        if len(x) - n_lags >= LEAST_ROWS:
            for name in models:
                y, off, weight = MODELS[name](x, dates, horizon, n_lags, test_size)
                band = 1.96 * off.std()
                for k, v in enumerate(y):
                    out.append((*key, name, k + 1, dates[-1] + datetime.timedelta(days=k + 1), v, max(0.0, v - band), v + band, float(np.sqrt((off**2).mean())), float(np.abs(off).mean()), weight))
        return pd.DataFrame(out, columns=[c.split()[0] for c in FORECAST.replace("map<string,double>", "map").split(", ")])

    rows = df.select(*KEYS, ORDER, F.col("date").cast("date").alias("date"), F.coalesce("new_cases", F.lit(0)).alias("new_cases"))
    return rows.groupBy(*KEYS).applyInPandas(run, FORECAST)


def ensemble_weights(metrics: DataFrame) -> DataFrame:
    """Adds weight: a model's inverse rmse over the sum of its series'; a missing or non-positive rmse counts as 1e6."""
    inverse = 1.0 / F.when(F.col("rmse") > 0, F.col("rmse")).otherwise(F.lit(1e6))
    w = Window.partitionBy(*KEYS)
    return metrics.withColumn("weight", inverse / F.sum(inverse).over(w))


def ensemble(forecasts: DataFrame) -> DataFrame:
    """Weighted means of the models of each series and step; its rmse is the weighted mean of theirs."""
    inverse = 1.0 / F.when(F.col("rmse") > 0, F.col("rmse")).otherwise(F.lit(1e6))
    w = Window.partitionBy(*KEYS, "step")
    x = forecasts.withColumn("weight", inverse / F.sum(inverse).over(w))
    mean = lambda c: F.sum(F.col(c) * F.col("weight")).alias(c)
    out = x.groupBy(*KEYS, "step").agg(F.min("date").alias("date"), mean("predicted"), mean("lower"), mean("upper"), mean("rmse"), F.array_sort(F.collect_list("model")).alias("models"))
    name = F.when(F.size("models") == 1, F.concat(F.lit("Ensemble ("), F.col("models")[0], F.lit(" only)"))).otherwise(F.concat(F.lit("Ensemble ("), F.array_join("models", " + "), F.lit(")")))
    return out.withColumn("model", name).drop("models")
