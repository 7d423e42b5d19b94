"""Bayesian online changepoints: a run-length posterior with a normal-inverse-gamma model.

With a constant hazard the probability that a run has just begun is the hazard itself, whatever the data. It is kept as
changepoint_prob; the run length most likely is what tells a change: it drops.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outbreak_spark.model import KEYS, ORDER, series

CHANGES = "region string, pathogen string, record_index long, changepoint_prob double, map_run_length int, expected_run_length double"


class RunLengths:
    """The posterior after each observation; lengths of less than `tail` mass at the far end are dropped; none if tail is 0."""

    _norms = np.empty(0)  # by run length, which alone sets the degrees of freedom

    @classmethod
    def norms(cls, n: int) -> np.ndarray:
        if len(cls._norms) < n:
            df = 2.0 + np.arange(2 * n)
            cls._norms = np.array([math.lgamma((d + 1) / 2) - math.lgamma(d / 2) for d in df]) - 0.5 * np.log(df * math.pi)
        return cls._norms[:n]

    def __init__(self, hazard_lambda: float = 100.0, tail: float = 1e-12):
        if hazard_lambda <= 1:
            raise ValueError("hazard_lambda must be above 1")
        self.hazard, self.tail = 1 / hazard_lambda, tail
        self.p = np.ones(1)
        self.mu, self.kappa, self.alpha, self.beta = np.zeros(1), np.ones(1), np.ones(1), np.ones(1)

    def step(self, x: float) -> tuple[float, int, float]:
        df = 2 * self.alpha
        scale2 = np.maximum(self.beta * (self.kappa + 1) / (self.alpha * self.kappa), 1e-20)
        log_t = self.norms(len(df)) - 0.5 * np.log(scale2) - (df + 1) / 2 * np.log1p((x - self.mu) ** 2 / (df * scale2))
        joint = self.p * np.maximum(np.exp(log_t), 1e-300)
        new = np.concatenate([[self.hazard * joint.sum()], (1 - self.hazard) * joint])
        new /= new.sum()
        mu = (self.kappa * self.mu + x) / (self.kappa + 1)
        beta = self.beta + self.kappa * (x - self.mu) ** 2 / (2 * (self.kappa + 1))
        self.mu, self.beta = np.r_[0.0, mu], np.r_[1.0, beta]
        self.kappa, self.alpha = np.r_[1.0, self.kappa + 1], np.r_[1.0, self.alpha + 0.5]
        keep = max(1, len(new) - int(np.searchsorted(np.cumsum(new[::-1]), self.tail)))
        self.p, self.mu, self.kappa, self.alpha, self.beta = (v[:keep] for v in (new, self.mu, self.kappa, self.alpha, self.beta))
        self.p = self.p / self.p.sum()
        return float(self.p[0]), int(self.p.argmax()), float(self.p @ np.arange(len(self.p)))


def changepoints(df: DataFrame, hazard_lambda: float = 100.0, threshold: float = 0.5, log: bool = True, column: str = "new_cases") -> DataFrame:
    """Per record: changepoint_prob, map_run_length, expected_run_length, is_changepoint (that probability above the
    threshold) and run_dropped (the likeliest run is shorter than the one before). One task per series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORDER)
        x = pdf[column].fillna(0).to_numpy(float)
        x = np.log1p(np.maximum(x, 0)) if log else x
        state = RunLengths(hazard_lambda)
        found = [state.step(v) for v in x]
        out = pdf[[*KEYS, ORDER]].copy()
        out["changepoint_prob"], out["map_run_length"], out["expected_run_length"] = zip(*found, strict=True)
        return out

    out = df.select(*KEYS, ORDER, column).groupBy(*KEYS).applyInPandas(run, CHANGES)
    out = out.withColumn("is_changepoint", F.col("changepoint_prob") > threshold)
    return out.withColumn("run_dropped", F.coalesce(F.col("map_run_length") < F.lag("map_run_length").over(series()), F.lit(False)))


def summary(changes: DataFrame) -> DataFrame:
    """Per series: the highest changepoint_prob, the number of changepoints and their record indices in order, and how
    often the likeliest run dropped."""
    at = F.array_sort(F.collect_list(F.when(F.col("is_changepoint"), F.col(ORDER))))
    return changes.groupBy(*KEYS).agg(F.max("changepoint_prob").alias("max_prob"), F.count_if("is_changepoint").alias("changepoints"), at.alias("indices"), F.count_if("run_dropped").alias("drops"))
