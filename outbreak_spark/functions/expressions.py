"""Column expressions: dates, intervals, classes, messages."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_of(confidence: float) -> float:
    return NormalDist().inv_cdf(1 - (1 - confidence) / 2)


def rounded(x: Column, digits: int) -> Column:
    """As SQL engines round binary fractions: the product with 10^digits, to a whole number. F.round() takes the decimal
    text instead, which is half way more often."""
    return F.round(x * 10.0**digits) / 10.0**digits


def iso_date(text: Column) -> Column:
    """The date of an ISO 8601 text (extended or basic; a time may follow), null if it isn't one."""
    long = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$")
    short = text.rlike(r"^\d{8}([T ].*)?$")
    return F.when(long, F.substring(text, 1, 10).try_cast("date")).when(short, F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd"))


def wilson(successes: Column, trials: Column, confidence: float = 0.95) -> Column:
    """Struct value, lower_ci, upper_ci, method of a proportion; null value without trials. A proportion above 1 has no
    score interval: [0, 1]."""
    z = z_of(confidence)
    n = F.nullif(trials, F.lit(0)).cast("double")
    p = successes / n
    centre, root = p + z * z / (2 * n), p * (1 - p) / n + z * z / (4 * n * n)
    half = z * F.sqrt(F.when(root >= 0, root))
    lower = F.coalesce(F.greatest(F.lit(0.0), (centre - half) / (1 + z * z / n)), F.lit(0.0))
    upper = F.coalesce(F.least(F.lit(1.0), (centre + half) / (1 + z * z / n)), F.lit(1.0))
    known = n.isNotNull()
    return F.struct(p.alias("value"), F.when(known, lower).alias("lower_ci"), F.when(known, upper).alias("upper_ci"), F.lit("wilson").alias("method"))


def phase(lower: Column, upper: Column) -> Column:
    return F.when(lower.isNull() | upper.isNull(), "unknown").when(lower > 1, "growing").when(upper < 1, "declining").otherwise("stable")


def alert_level(rt: Column, doubling_time: Column | None = None, rapid_days: float | None = None) -> Column:
    """GREEN, YELLOW, ORANGE, RED by reproduction number; RED too below rapid_days to double, if given."""
    level = F.when(rt < 0.8, "GREEN").when(rt < 1.0, "YELLOW").when(rt < 1.5, "ORANGE").when(rt >= 1.5, "RED")
    if doubling_time is not None and rapid_days is not None:
        level = F.when(rt.isNotNull() & (doubling_time > 0) & (doubling_time < rapid_days), "RED").otherwise(level)
    return level


def quality_gate(score: Column) -> Column:
    return F.when(score >= 0.7, "PASS").when(score >= 0.5, "CONDITIONAL").otherwise("FAIL")


def seir_rates(r0: Column, latent: Column, infectious: Column) -> Column:
    """Struct beta, sigma, gamma."""
    gamma = 1 / infectious
    return F.struct((r0 * gamma).alias("beta"), (1 / latent).alias("sigma"), gamma.alias("gamma"))


def seir_periods(beta: Column, sigma: Column, gamma: Column) -> Column:
    """Struct r0, latent_days, infectious_days, serial_interval; infinite where a rate is 0."""
    infinite = F.lit(float("inf"))
    over = lambda x: F.when(x == 0, infinite).otherwise(F.try_divide(F.lit(1.0), x))
    r0 = F.when(gamma == 0, infinite).otherwise(F.try_divide(beta, gamma))
    return F.struct(r0.alias("r0"), over(sigma).alias("latent_days"), over(gamma).alias("infectious_days"), (over(sigma) + over(gamma)).alias("serial_interval"))


def force_of_infection(beta: Column, s: Column, i: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.0), beta * s * i / n)
