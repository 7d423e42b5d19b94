"""Effective reproduction number: renewal equation with a gamma posterior, as window expressions over each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outbreak_spark.functions.expressions import phase
from outbreak_spark.functions.quantiles import gamma_quantile
from outbreak_spark.model import ALIASES, DEFAULT_PATHOGEN, KEYS, ORDER, SERIAL_INTERVALS, interval_of, serial_interval, series


def weights_of(pathogen: str | None, max_days: int = 20) -> list[float]:
    """Rounded, so that texts of queries can share them."""
    return [round(w, 15) for w in serial_interval(*interval_of(pathogen), max_days)]


def weights_by_pathogen(max_days: int = 20) -> list[Column]:
    """Each row's weights, by its pathogen's name or other name in any case; unknown ones have the default pathogen's."""
    name, known = F.lower("pathogen"), {n: weights_of(n, max_days) for n in SERIAL_INTERVALS}
    called = {n: [n, *(a for a, m in ALIASES.items() if m == n)] for n in known if n != DEFAULT_PATHOGEN}
    out = []
    for s in range(max_days + 1):
        w = F
        for n, names in called.items():
            w = w.when(name.isin(names), F.lit(known[n][s]))
        out.append(w.otherwise(F.lit(known[DEFAULT_PATHOGEN][s])))
    return out


def infectiousness(df: DataFrame, weights: list[float] | None = None, column: str = "new_cases") -> DataFrame:
    """Adds lam: cases of the last days, each weighted by the chance that it infects today. One exchange and sort.
    Without weights, each series has those of its pathogen."""
    w, lam = series(), F.lit(0.0)
    own = weights_by_pathogen() if weights is None else [F.lit(x) for x in weights]
    for s in range(1, len(own)):
        lam = lam + F.coalesce(F.lag(column, s).over(w), F.lit(0)) * own[s]
    return df.withColumn("lam", lam)


def posterior(df: DataFrame, weights: list[float] | None = None, window: int = 7, prior: tuple[float, float] = (1.0, 5.0), column: str = "new_cases") -> DataFrame:
    """Adds shape, scale, rt_mean and is_prior_dominated from day `window` on (records before it are left out). Without
    any infectiousness in the window they are null."""
    if window < 1:
        raise ValueError("window must be positive")
    w = series()
    last = w.rowsBetween(1 - window, 0)
    x = infectiousness(df, weights, column).withColumn("at", F.row_number().over(w))
    x = x.withColumn("sum_i", F.sum(column).over(last)).withColumn("sum_lam", F.sum("lam").over(last)).where(F.col("at") > window)
    known = F.col("sum_lam") > 0
    shape, scale = prior[0] + F.col("sum_i"), 1.0 / (1.0 / prior[1] + F.col("sum_lam"))
    x = x.withColumn("shape", F.when(known, shape)).withColumn("scale", F.when(known, scale))
    x = x.withColumn("rt_mean", F.col("shape") * F.col("scale"))
    return x.withColumn("is_prior_dominated", known & (F.col("sum_i") + F.col("sum_lam") < prior[0])).drop("at")


def estimate_rt(df: DataFrame, weights: list[float] | None = None, window: int = 7, prior: tuple[float, float] = (1.0, 5.0), confidence: float = 0.95) -> DataFrame:
    """posterior() with rt_lower, rt_upper (quantiles) and phase."""
    tail, x = (1 - confidence) / 2, posterior(df, weights, window, prior)
    for name, p in (("rt_lower", tail), ("rt_upper", 1 - tail)):
        x = x.withColumn(name, gamma_quantile(p, F.col("shape"), F.col("scale")))
    return x.withColumn("phase", phase(F.col("rt_lower"), F.col("rt_upper")))


def current(df: DataFrame, *columns: str) -> DataFrame:
    """The columns at each series' last record with a known rt_mean, and the range and number of such records."""
    known = df.where("rt_mean is not null")
    return known.groupBy(*KEYS).agg(*(F.max_by(c, ORDER).alias(c) for c in columns), F.min("rt_mean").alias("rt_min"), F.max("rt_mean").alias("rt_max"), F.count("*").alias("n_valid"))
