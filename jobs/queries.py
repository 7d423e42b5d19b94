"""The jobs as queries: each runs twice into one new folder, and gives the whole output as it stands then; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import deidentify, surveillance
from outbreak_spark.functions.expressions import rounded
from outbreak_spark.model import KEYS
from outbreak_spark.plans import oracle
from outbreak_spark.shared import new_folder


def job1_deidentify(spark: SparkSession, path: str) -> DataFrame:
    """Redacted texts of documents and conversations, from the stream."""
    at = new_folder(spark, "deidentify")
    for _ in range(2):
        deidentify.run(spark, path, f"{at}/texts", f"{at}/checkpoint")
    return deidentify.texts(spark, f"{at}/texts").select("kind", "part", "id", "clean", F.array_join("types", ",").alias("types"), "n_chars")


def job2_surveillance(spark: SparkSession, path: str) -> DataFrame:
    """Each day's reproduction number beside its series' summary."""
    at = new_folder(spark, "surveillance")
    for _ in range(2):
        surveillance.run(spark, path, at)
    days, series = (spark.read.parquet(f"{at}/{name}") for name in ("reproduction", "summary"))
    series = series.select(*KEYS, *(F.col(c).alias(f"series_{c}") for c in series.columns if c not in KEYS))
    out = series.join(days, KEYS, "left")
    out = out.select(*(rounded(F.col(c), 6).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in out.dtypes))
    return out


QUERIES = {f.__name__: f for f in (job1_deidentify, job2_surveillance)}
SQL = {"job1_deidentify": oracle.DEIDENTIFIED, "job2_surveillance": oracle.SURVEILLANCE}
