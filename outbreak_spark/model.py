"""Schemas, keys and fixed dimension values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import types as T

#: A series, and the order of its records.
KEYS = ["region", "pathogen"]
ORDER = "record_index"

RECORD = T.StructType(
    [
        T.StructField("record_index", T.LongType()),
        T.StructField("date", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("pathogen", T.StringType()),
        T.StructField("new_cases", T.LongType()),
        T.StructField("cumulative_cases", T.LongType()),
        T.StructField("new_deaths", T.LongType()),
        T.StructField("cumulative_deaths", T.LongType()),
        T.StructField("population", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

# People per region, pathogen profiles (reproduction number, latent and infectious days, fatality,
# population) and serial intervals (mean and standard deviation in days), with the names they also go by.
POPULATION = {
    "nat": 330_000_000,
    "us_national": 330_000_000,
    "hhs1": 15_000_000,
    "hhs2": 25_000_000,
    "hhs3": 30_000_000,
    "hhs4": 65_000_000,
    "hhs5": 50_000_000,
    "hhs6": 40_000_000,
    "hhs7": 10_000_000,
    "hhs8": 12_000_000,
    "hhs9": 55_000_000,
    "hhs10": 8_000_000,
    "synthetic_region": 1_000_000,
}
PROFILES = {
    "influenza": (1.3, 2.0, 3.0, 0.001, 1_000_000),
    "covid-19": (2.5, 5.2, 2.9, 0.015, 1_000_000),
    "measles": (12.0, 10.0, 8.0, 0.002, 1_000_000),
}
SERIAL_INTERVALS = {"influenza": (2.6, 1.5), "covid-19": (4.7, 2.9), "measles": (11.5, 2.0)}
ALIASES = {"covid": "covid-19", "flu": "influenza"}
DEFAULT_PATHOGEN = "covid-19"


def series():
    """The window of a series in record order; the same everywhere, so that one exchange serves all."""
    return Window.partitionBy(*KEYS).orderBy(ORDER)


def serial_interval(mean: float, std: float, max_days: int = 20) -> list[float]:
    """Weights for 0 .. max_days days between cases: a gamma density at whole days, none at 0, summing to 1."""
    if mean <= 0 or std <= 0:
        raise ValueError(f"mean and std must be positive: {mean}, {std}")
    shape, scale = (mean / std) ** 2, std**2 / mean
    logs = [(shape - 1) * math.log(d) - d / scale - math.lgamma(shape) - shape * math.log(scale) for d in range(1, max_days + 1)]
    weights = [math.exp(x) for x in logs]
    total = sum(weights)
    if total <= 0:
        return [0.0] + [1.0 / max_days] * max_days
    return [0.0, *(w / total for w in weights)]


def population_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(POPULATION.items()), "region string, population long")


def profile_table(spark: SparkSession) -> DataFrame:
    """One row per name, other names included."""
    rows = [(n, n, *p) for n, p in PROFILES.items()] + [(a, n, *PROFILES[n]) for a, n in ALIASES.items()]
    return spark.createDataFrame(rows, "name string, pathogen string, r0 double, latent_days double, infectious_days double, cfr double, population long")


def serial_interval_table(spark: SparkSession, max_days: int = 20) -> DataFrame:
    """pathogen, day, weight."""
    rows = [(n, d, w) for n, si in SERIAL_INTERVALS.items() for d, w in enumerate(serial_interval(*si, max_days))]
    return spark.createDataFrame(rows, "pathogen string, day int, weight double")


def interval_of(pathogen: str | None) -> tuple[float, float]:
    """Serial interval by name, case-insensitive; unknown: that of the default pathogen."""
    name = (pathogen or "").lower()
    return SERIAL_INTERVALS.get(ALIASES.get(name, name), SERIAL_INTERVALS[DEFAULT_PATHOGEN])
