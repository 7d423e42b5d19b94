"""Case fatality, attack and incidence rates, growth and doubling time, dataset summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outbreak_spark.functions.expressions import wilson, z_of
from outbreak_spark.functions.quantiles import gamma_quantile
from outbreak_spark.model import KEYS, ORDER


def totals(df: DataFrame) -> DataFrame:
    """Per series: records, cases, deaths, population, first and last date, and the day with most cases (the first)."""
    peak = F.max_by(F.struct("date", "new_cases"), F.struct(F.col("new_cases"), -F.col(ORDER)))
    return df.groupBy(*KEYS).agg(F.count("*").alias("records"), F.sum("new_cases").alias("cases"), F.sum("new_deaths").alias("deaths"), F.max("population").alias("population"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), peak.alias("peak")).select("*", F.col("peak.date").alias("peak_date"), F.col("peak.new_cases").alias("peak_cases")).drop("peak")


def _error(df: DataFrame, bad, text: str) -> DataFrame:
    """Adds the text to the column error of bad rows; the column is null where nothing is wrong."""
    had = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    return df.withColumn("error", F.nullif(F.concat_ws("; ", had, F.when(bad, text)), F.lit("")))


def case_fatality(df: DataFrame, deaths: str = "deaths", cases: str = "cases", confidence: float = 0.95) -> DataFrame:
    """Adds cfr: deaths / cases with its Wilson interval; null, with a text in error, for negative counts."""
    bad = (F.col(deaths) < 0) | (F.col(cases) < 0)
    return _error(df.withColumn("cfr", F.when(~bad, wilson(F.col(deaths), F.col(cases), confidence))), bad, "counts must not be negative")


def attack_rate(df: DataFrame, cases: str = "cases", population: str = "population", confidence: float = 0.95) -> DataFrame:
    """Adds attack_rate; null, with a text in error, for a population that isn't positive."""
    bad = F.col(population).isNull() | (F.col(population) <= 0)
    return _error(df.withColumn("attack_rate", F.when(~bad, wilson(F.col(cases), F.col(population), confidence))), bad, "population must be positive")


def incidence_rate(df: DataFrame, cases: str = "cases", population: str = "population", per: float = 100_000, confidence: float = 0.95) -> DataFrame:
    """Adds incidence: cases per so many people with the exact Poisson interval; null, with a text in
    error, for a population of 0 or less and for negative cases."""
    tail = (1 - confidence) / 2
    bad = F.col(population).isNull() | (F.col(population) <= 0) | (F.col(cases) < 0)
    df = _error(df, bad, "incidence needs a positive population and cases of 0 or more")
    k = F.when(~bad, F.col(cases).cast("double"))
    lower = F.when(k == 0, 0.0).otherwise(gamma_quantile(tail, k))  # half a chi-square of 2k
    scale = F.when(~bad, F.try_divide(F.lit(float(per)), F.col(population)))
    return df.withColumn("incidence", F.struct((F.try_divide(k, F.col(population)) * per).alias("value"), (lower * scale).alias("lower_ci"), (gamma_quantile(1 - tail, k + 1) * scale).alias("upper_ci"), F.lit("exact_poisson").alias("method")))


def growth(df: DataFrame, window: int = 7, confidence: float = 0.95) -> DataFrame:
    """Per series: growth_rate (slope of log cases over the last `window` records, positive ones only, at least three),
    its standard error and normal interval, and the doubling time where it grows."""
    if window < 3:
        raise ValueError("window must be 3 at least")
    back = Window.partitionBy(*KEYS).orderBy(F.desc(ORDER))
    last = df.withColumn("__r", F.row_number().over(back)).where(F.col("__r") <= window)
    x, y = (F.lit(window) - F.col("__r")).cast("double"), F.when(F.col("new_cases") > 0, F.ln(F.col("new_cases").cast("double")))
    fit = last.select(*KEYS, F.when(y.isNotNull(), x).alias("x"), y.alias("y")).groupBy(*KEYS).agg(F.count("y").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"))
    enough = F.col("n") >= 3
    left = F.greatest(F.lit(0.0), (1 - F.coalesce(F.nanvl("r2", F.lit(1.0)), F.lit(1.0))) * F.col("syy"))
    error = F.sqrt(F.try_divide(F.try_divide(left, F.col("sxx")), F.nullif(F.col("n") - 2, F.lit(0))))
    z, ln2 = z_of(confidence), math.log(2)
    grows = F.col("growth_rate") > 1e-12  # not rounding noise of a flat series
    g = fit.select(*KEYS, "n", F.when(enough, F.col("slope")).alias("growth_rate"), F.when(enough, error).alias("se"))
    g = g.withColumn("growth_lower", F.col("growth_rate") - z * F.col("se")).withColumn("growth_upper", F.col("growth_rate") + z * F.col("se"))
    g = g.withColumn("doubling_time", F.when(grows, F.lit(ln2) / F.when(grows, F.col("growth_rate"))))
    spread = z * F.col("se") * F.lit(ln2) / F.nullif(F.col("growth_rate") * F.col("growth_rate"), F.lit(0.0))
    known = F.col("doubling_time").isNotNull()
    return g.withColumn("doubling_lower", F.when(known, F.greatest(F.lit(0.0), F.col("doubling_time") - spread))).withColumn("doubling_upper", F.when(known, F.col("doubling_time") + spread))


def epi_metrics(df: DataFrame, window: int = 7, per: float = 100_000) -> DataFrame:
    """All of them, a row per series; those over time only for series of `window` records at least."""
    t = incidence_rate(attack_rate(case_fatality(totals(df))), per=per)
    g = growth(df, window)
    out = t.join(g.drop("n"), KEYS, "left")
    for c in ("growth_rate", "se", "growth_lower", "growth_upper", "doubling_time", "doubling_lower", "doubling_upper"):
        out = out.withColumn(c, F.when(F.col("records") >= window, F.col(c)))
    return out


def contents(df: DataFrame) -> DataFrame:
    """One row: the regions and the pathogens of a dataset, distinct and sorted."""
    one = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s")
    return df.select(*KEYS).distinct().agg(one("region"), one("pathogen"))


def rolling_curve(df: DataFrame, days: int = 7) -> DataFrame:
    """Mean of the last `days` records, from the first full window on."""
    w = Window.partitionBy(*KEYS).orderBy(ORDER)
    return df.select(*KEYS, "date", "new_cases", F.avg("new_cases").over(w.rowsBetween(1 - days, 0)).alias("mean"), F.row_number().over(w).alias("__n")).where(F.col("__n") >= days).drop("__n")


def top_days(df: DataFrame, k: int = 5) -> DataFrame:
    """Each series' k days with most cases, ties to the earlier."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("new_cases"), ORDER)
    return df.select(*KEYS, "date", "new_cases", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
