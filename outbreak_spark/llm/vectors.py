"""What both searches share: valid vectors, matrices, and the best of each query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid(table: DataFrame, zero: bool) -> DataFrame:
    """vec_id, embedding as array<double>, of the rows that take part: not null, not empty, no null or non-finite
    component, of the most frequent length (ties: the shortest), as only vectors of one length have a product; zero:
    whether all-zero vectors take part."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    keep = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", fine)
    if not zero:
        keep &= F.exists("embedding", lambda x: x != 0)
    rows = rows.where(keep)
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (length.n if length else 0))


def queries_of(rows: DataFrame, is_query) -> DataFrame:
    """One row per vec_id that is a query: repeated ones are asked once."""
    return rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column) -> np.ndarray:
    """An array column as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def dealt(blocks: int, *key: str):
    return F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int")


def every(blocks: int):
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
