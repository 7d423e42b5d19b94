"""Looking back over one list of all records, without a task that holds it.

A window without a partition sorts a whole table in one task. Here the list is cut into blocks of consecutive positions,
each a window partition of its own, and what a block needs from those before it (their last row, their sums) is carried
over: one row per block goes through one task, and back by a broadcast of that many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block.
BLOCK = 1 << 20


def _block(order: str, size: int) -> Column:
    return F.floor(F.col(order) / size)


def _carried(df: DataFrame, order: str, size: int, aggregates: dict[str, Column], over: dict[str, Column]) -> DataFrame:
    """__b and a column per name of `over`: aggregates of each block, looked at from the blocks after it. Blocks are
    few: a row for every `size` positions."""
    blocks = df.groupBy(_block(order, size).alias("__b")).agg(*(a.alias(f"__a_{n}") for n, a in aggregates.items()))
    return blocks.select("__b", *(c.alias(n) for n, c in over.items()))


def with_previous(df: DataFrame, columns: list[str], prefix: str = "__", order: str = "record_index", size: int = BLOCK) -> DataFrame:
    """Adds prefix + column: its value in the record before, in the order of the whole list; null for the first. Positions
    must differ; they may have gaps. Null positions form a list of their own, of which nothing is before another."""
    w, before = Window.partitionBy("__b").orderBy(order), Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    row = F.struct(*columns)
    last = _carried(df, order, size, {"last": F.max_by(row, order)}, {"__last": F.last("__a_last", ignorenulls=True).over(before)})
    x = df.withColumn("__b", _block(order, size))
    x = x.select("*", F.lag(row).over(w).alias("__here"), F.row_number().over(w).alias("__n"))
    x = x.join(F.broadcast(last), "__b", "left")  # a row per block
    known = F.when(F.col(order).isNotNull(), F.when(F.col("__n") == 1, F.col("__last")).otherwise(F.col("__here")))
    return x.withColumn("__before", known).select(*df.columns, *(F.col(f"__before.{c}").alias(prefix + c) for c in columns))


def with_running_sum(df: DataFrame, columns: list[str], prefix: str = "sum_", order: str = "record_index", size: int = BLOCK) -> DataFrame:
    """Adds prefix + column: its sum up to and with the record, in the order of the whole list; nulls count nothing."""
    w = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    earlier = _carried(df, order, size, {c: F.sum(c) for c in columns}, {f"__s_{c}": zero(F.sum(f"__a_{c}").over(before)) for c in columns})
    x = df.withColumn("__b", _block(order, size))
    x = x.select("*", *(zero(F.sum(c).over(w)).alias(f"__w_{c}") for c in columns)).join(F.broadcast(earlier), "__b", "left")  # a row per block
    return x.select(*df.columns, *((F.col(f"__w_{c}") + zero(F.col(f"__s_{c}"))).alias(prefix + c) for c in columns))
