"""Records from JSON: arrays in a string column, files, and the epidemiological week REST payload."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from outbreak_spark.model import RECORD

_ONE = T.StructType([f for f in RECORD.fields if f.name != "record_index"])


def parse_records(df: DataFrame, column: str) -> DataFrame:
    """One row per element of a JSON array of records; record_index is its place. Null where the text isn't such."""
    parsed = F.from_json(F.col(column), T.ArrayType(_ONE))
    return df.select(F.posexplode_outer(parsed).alias("record_index", "r")).select(F.col("record_index").cast("long"), "r.*")


def epiweek_to_date(week: Column, legacy: bool = False) -> Column:
    """Saturday that ends an epidemiological week, given as year * 100 + week; null if it isn't one.

    Weeks run from Sunday, and week 1 holds January 4. legacy: the week of the Monday of ISO week 1, less a day, which
    is a week early in years whose January 4 is a Sunday.
    """
    year, number = F.floor(week / 100).cast("int"), (week % 100).cast("int")
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.weekday(fourth)
    back = monday + 1 if legacy else F.pmod(monday + 1, F.lit(7))
    return F.when((number >= 1) & (number <= 53), F.date_add(F.date_sub(fourth, back), (number - 1) * 7 + 6))


PAYLOAD = "result int, message string, epidata array<struct<epiweek:int,region:string,num_ili:bigint,num_patients:bigint>>"


def from_payload(payload: DataFrame, legacy: bool = False) -> DataFrame:
    """Records of the week of each row of a payload; nothing if its result isn't 1. Missing counts are 0."""
    rows = payload.where("result = 1").select(F.posexplode("epidata").alias("record_index", "e")).select(F.col("record_index").cast("long"), "e.*")
    zero = F.lit(0).cast("long")
    return rows.select(
        "record_index", F.date_format(epiweek_to_date(F.col("epiweek"), legacy), "yyyy-MM-dd").alias("date"), "region", F.lit("influenza").alias("pathogen"), F.coalesce("num_ili", zero).alias("new_cases"), zero.alias("cumulative_cases"), zero.alias("new_deaths"), zero.alias("cumulative_deaths"),
        F.when(F.col("region") == "nat", F.lit(330_000_000)).otherwise(F.lit(33_000_000)).cast("long").alias("population"), F.lit("cdc_fluview").alias("source"), F.create_map().cast("map<string,string>").alias("metadata"),
    )


def read_payload(spark: SparkSession, path: str, legacy: bool = False) -> DataFrame:
    """A saved payload, one JSON object per file."""
    return from_payload(spark.read.schema(PAYLOAD).option("multiLine", True).json(path), legacy)


class FluViewSource(DataSource):
    """spark.read.format("fluview").option("regions", ...).option("epiweeks", "202301-202352").load(); option endpoint
    = meta for the metadata as one JSON text. One partition, one request; errors give no rows."""

    @classmethod
    def name(cls) -> str:
        return "fluview"

    def schema(self) -> str:
        return "body string" if self.options.get("endpoint") == "meta" else PAYLOAD

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _FluViewReader(dict(self.options))


class _FluViewReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from urllib.error import URLError
        from urllib.parse import urlencode
        from urllib.request import urlopen

        base = self.options.get("url", "https://api.delphi.cmu.edu/epidata")
        meta = self.options.get("endpoint") == "meta"
        query = "" if meta else "?" + urlencode({"regions": self.options.get("regions", "nat"), "epiweeks": self.options.get("epiweeks", "202301-202352")})
        try:
            with urlopen(f"{base}/fluview{'_meta' if meta else ''}/{query}", timeout=30) as answer:
                body = json.load(answer)
        except (URLError, ValueError, OSError):
            return
        if meta:
            yield (json.dumps(body.get("epidata", {})),)
        else:
            yield body.get("result"), body.get("message"), [(r.get("epiweek"), r.get("region"), r.get("num_ili"), r.get("num_patients")) for r in body.get("epidata") or []]
