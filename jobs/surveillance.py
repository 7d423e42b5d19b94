"""Analysis of all series of an event table: daily reproduction numbers and one summary row per region and pathogen.

    python jobs/surveillance.py --config jobs/surveillance.json --input DIR --output DIR

Daily counts are written once, bucketed and sorted by series. Every figure comes from that table: windows, aggregates and
joins by series find their rows in place, so that nothing but the counts themselves is shuffled, however many figures there
are. Results are Parquet by pathogen, written with dynamic partition overwrite: a rerun replaces what it computes again,
and a run for some pathogens leaves the others' partitions alone.
"""

from __future__ import annotations

import argparse
import datetime
import json
import logging
import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from outbreak_spark.model import KEYS, ORDER  # noqa: E402
from outbreak_spark.operators import metrics, quality, report, rt  # noqa: E402
from outbreak_spark.sources import tables  # noqa: E402

LOG = logging.getLogger("surveillance")
#: pathogens: those to compute (null: all). as_of: dates after it are faults (null: the last date there is). rapid_days: a
#: doubling time below it is a red alert (null: none). buckets: of the daily table; files: per pathogen and output.
DEFAULTS = {"pathogens": None, "as_of": None, "rapid_days": None, "buckets": 16, "files": 4}


def bucketed(daily: DataFrame, path: str, buckets: int) -> str:
    """Writes daily counts by series to the path; the name of a table over it, new for each call."""
    name = f"daily_{uuid.uuid4().hex}"
    daily.repartition(buckets, *KEYS).write.mode("overwrite").bucketBy(buckets, *KEYS).sortBy(*KEYS, ORDER).option("path", path).saveAsTable(name)
    return name


def reproduction(daily: DataFrame) -> DataFrame:
    """Each day's cases and reproduction number, from the first full window on."""
    return rt.estimate_rt(daily).select(*KEYS, ORDER, "date", "new_cases", "rt_mean", "rt_lower", "rt_upper", "phase")


def summary(daily: DataFrame, as_of: datetime.date, rapid_days: float | None) -> DataFrame:
    """One row per series: totals, rates with their intervals, growth, current reproduction number, quality and alert."""
    now = rt.current(reproduction(daily), "rt_mean", "rt_lower", "rt_upper", "phase").drop("rt_min", "rt_max", "n_valid")
    score = quality.report(daily, quality.issues(daily, as_of=as_of), by=tuple(KEYS))
    x = report.situation_report(metrics.epi_metrics(daily), now, score, rapid_days).join(now.select(*KEYS, "rt_lower", "rt_upper"), KEYS, "left")
    rates = [F.col(f"{r}.{c}").alias(r + end) for r in ("cfr", "attack_rate", "incidence") for c, end in (("value", ""), ("lower_ci", "_lower"), ("upper_ci", "_upper"))]
    return x.select(*KEYS, "alert_level", "gate", "quality_score", "cases", "deaths", *rates, "growth_rate", "doubling_time", "rt_mean", "rt_lower", "rt_upper", "phase", "peak_date", "peak_cases", "summary")


def run(spark: SparkSession, source: str, output: str, config: dict | None = None) -> dict:
    """Computes and writes `daily`, `reproduction` and `summary` under the output; returns what was read and written."""
    config = DEFAULTS | (config or {})
    daily = tables.from_events(spark, source)
    if config["pathogens"] is not None:
        daily = daily.where(F.col("pathogen").isin(config["pathogens"]))
    name = bucketed(daily, f"{output}/daily", config["buckets"])
    try:
        daily = spark.table(name)
        seen = daily.agg(F.coalesce(F.sum("new_cases"), F.lit(0)).alias("events"), F.count("*").alias("days"), F.max("date").alias("last")).first()
        as_of = datetime.date.fromisoformat(config["as_of"]) if config["as_of"] else seen["last"] or datetime.date.today()
        LOG.info("%s: %s events, %s days of series up to %s", source, seen.events, seen.days, as_of)
        told = {"events": seen.events, "days": seen.days}
        for what, out in (("reproduction", reproduction(daily)), ("summary", summary(daily, as_of, config["rapid_days"]))):
            slot = F.pmod(F.xxhash64(*KEYS), F.lit(config["files"]))
            out.repartition("pathogen", slot).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pathogen").parquet(f"{output}/{what}")
            told[what] = spark.read.parquet(f"{output}/{what}").count() if seen.days else 0
            LOG.info("%s/%s: %s rows", output, what, told[what])
        return told
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # of the catalog only: the files stay


def main(args: list[str]) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--config", help="JSON file; values replace the defaults")
    for name in ("input", "output"):
        parser.add_argument(f"--{name}", required=True)
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = {}
    if given.config:
        with open(given.config, encoding="utf-8") as file:
            config = json.load(file)
    spark = SparkSession.builder.appName("surveillance").getOrCreate()
    try:
        run(spark, given.input, given.output, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
