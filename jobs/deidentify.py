"""De-identification of text tables as files arrive: redacted texts, and what was found in them.

    python jobs/deidentify.py --config jobs/deidentify.json --input DIR --output DIR --checkpoint DIR

A file stream per table takes what the checkpoint hasn't seen, redacts each text, and stops when there is nothing more.
The output, Parquet by kind of text and part, is written by Spark's file sink, whose log and the checkpoint make reruns
safe: each input row is in the output once, however often a run is stopped and started. Read it with spark.read.parquet.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from outbreak_spark.functions.privacy import strip_pii  # noqa: E402

LOG = logging.getLogger("deidentify")
#: tables: name -> kind; columns that identify a text, joined by a dash; the column by which texts are parted.
DEFAULTS = {
    "tables": {"documents": {"kind": "document", "id": ["doc_id"], "part": "source"}, "conversations": {"kind": "conversation", "id": ["conv_id", "turn"], "part": "role"}},
    "max_files_per_trigger": 1000,
    "max_file_age": "3650d",
    "tasks_per_part": 8,
}


def texts_of(rows: DataFrame, table: dict) -> DataFrame:
    """kind, part, id and text. A null or empty part is named none; a null text stays null."""
    name = F.concat_ws("-", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in table["id"]))
    return rows.select(F.lit(table["kind"]).alias("kind"), F.coalesce(F.nullif(F.col(table["part"]).cast("string"), F.lit("")), F.lit("none")).alias("part"), name.alias("id"), F.col("text").cast("string").alias("text"))


def redacted(texts: DataFrame, tasks_per_part: int) -> DataFrame:
    """kind, part, id, clean, types (sorted), n_chars, each part dealt to so many tasks: a part may hold a third of all."""
    dealt = texts.withColumn("slot", F.pmod(F.xxhash64("id", "text"), F.lit(tasks_per_part))).repartition("kind", "part", "slot")
    out = strip_pii(dealt, "text", "clean", "types")
    return out.select("kind", "part", "id", "clean", "types", F.length("clean").cast("long").alias("n_chars"))


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict | None = None) -> list[dict]:
    """Takes all files of the tables under `source` that the checkpoint doesn't know; returns what each batch (of the last
    100) read and wrote, in order; an empty list if nothing was new. A table that isn't there is an error. Files of
    max_file_age before the newest one are taken for old and left out: far more than any delay."""
    config = DEFAULTS | (config or {})
    parts = []
    for name, table in config["tables"].items():
        schema = spark.read.parquet(f"{source}/{name}.parquet").schema
        # As a pattern, since a table may be a folder or one file, of which a stream takes no plain path.
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["max_files_per_trigger"]).option("maxFileAge", config["max_file_age"]).parquet(f"{source}/{{{name}.parquet}}")
        parts.append(texts_of(stream, table))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    found = F.size("types") > 0
    seen = redacted(rows, config["tasks_per_part"]).observe(
        "written", F.count("*").alias("texts"), F.coalesce(F.sum(F.when(found, 1)), F.lit(0)).alias("with_identifiers"), F.coalesce(F.sum(F.size("types")), F.lit(0)).alias("types"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("characters")
    )
    writer = seen.writeStream.format("parquet").partitionBy("kind", "part").option("path", output).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    batches = []
    for p in query.recentProgress:
        if p.numInputRows:
            batches.append({"batch": p.batchId, "read": p.numInputRows, **p.observedMetrics["written"].asDict()})
            LOG.info("batch %(batch)s: read %(read)s rows, wrote %(texts)s texts of %(characters)s characters, %(with_identifiers)s with identifiers", batches[-1])
    LOG.info("%s: %s batches to %s", source, len(batches), output)
    return batches


def texts(spark: SparkSession, output: str) -> DataFrame:
    """The output, whose parts' names are texts even if they look like numbers."""
    return spark.read.schema("id string, clean string, types array<string>, n_chars long, kind string, part string").parquet(output)


def findings(spark: SparkSession, output: str) -> DataFrame:
    """kind, part, type, texts: in how many texts of the output each type of identifier was found, by batch-independent
    aggregation of what is there."""
    return texts(spark, output).select("kind", "part", F.explode("types").alias("type")).groupBy("kind", "part", "type").agg(F.count("*").alias("texts"))


def main(args: list[str]) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--config", help="JSON file; values replace the defaults")
    for name in ("input", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = {}
    if given.config:
        with open(given.config, encoding="utf-8") as file:
            config = json.load(file)
    spark = SparkSession.builder.appName("deidentify").getOrCreate()
    try:
        run(spark, given.input, given.output, given.checkpoint, config)
        for r in findings(spark, given.output).groupBy("kind", "type").agg(F.sum("texts").alias("texts")).orderBy("kind", "type").collect():  # at most kinds x types
            LOG.info("%s: %s in %s texts", r.kind, r.type, r.texts)
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
