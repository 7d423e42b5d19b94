"""Surveillance records from the star-schema and event tables: one exchange for the counts, one for the series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outbreak_spark.model import KEYS, series


def cumulative(daily: DataFrame) -> DataFrame:
    """Adds record_index (0, 1, ... by date) and running sums of cases and deaths per series."""
    w = series().orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.withColumn("record_index", F.row_number().over(series().orderBy("date")).cast("long") - 1)
    return daily.withColumn("cumulative_cases", F.sum("new_cases").over(w)).withColumn("cumulative_deaths", F.sum("new_deaths").over(w))


def from_events(spark: SparkSession, path: str) -> DataFrame:
    """Daily counts of events per region (five by user) and type."""
    events = spark.read.parquet(f"{path}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    keyed = events.select(F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("region"), F.col("event_type").alias("pathogen"), F.to_date("ts").alias("date"), "event_id", (F.lit(1_000_000) * (F.col("user_id") % 5 + 1)).alias("people"))
    daily = keyed.groupBy(*KEYS, "date").agg(F.count("*").alias("new_cases"), F.count_if(F.col("event_id") % 50 == 0).alias("new_deaths"), F.max("people").alias("population"))
    return cumulative(daily.withColumn("source", F.lit("events")))


def shipments(spark: SparkSession, path: str) -> DataFrame:
    """Daily quantities shipped per region of the customer, as one pathogen named ship; days without are absent."""
    read = lambda t, *c: spark.read.parquet(f"{path}/{t}.parquet").select(*c)
    facts = read("lineitem", "l_orderkey", "l_quantity", "l_returnflag", "l_shipdate").join(read("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    facts = facts.join(read("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    facts = facts.join(read("nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    keyed = facts.select(F.col("r_name").alias("region"), F.lit("ship").alias("pathogen"), F.to_date("l_shipdate").alias("date"), "l_quantity", "l_returnflag", (F.lit(1_000_000) * (F.col("r_regionkey") + 1)).cast("long").alias("people"))
    return keyed.groupBy(*KEYS, "date").agg(F.sum("l_quantity").cast("long").alias("new_cases"), F.count_if(F.col("l_returnflag") == "R").alias("new_deaths"), F.max("people").alias("population"))


def calendar(daily: DataFrame) -> DataFrame:
    """Every day from each series' first to its last, missing ones with zero counts."""
    spine = daily.groupBy(*KEYS).agg(F.min("date").alias("a"), F.max("date").alias("b"), F.max("population").alias("people"))
    spine = spine.select(*KEYS, "people", F.explode(F.sequence("a", "b")).alias("date"))
    full = spine.join(daily, [*KEYS, "date"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return full.select(*KEYS, "date", zero("new_cases"), zero("new_deaths"), F.coalesce("population", "people").alias("population"))


def from_shipments(spark: SparkSession, path: str) -> DataFrame:
    return cumulative(calendar(shipments(spark, path)).withColumn("source", F.lit("shipments")))
