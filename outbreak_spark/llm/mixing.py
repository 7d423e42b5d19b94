"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target / size = r is wanted r times: floor(r) copies are certain, one more has the
fractional probability. Probabilities are rounded in pairs: mass, counted in words, moves at random between two
documents until one is taken or left for sure, in such proportions that each keeps its expected copies and the pair
its expected words. Pairs are formed from the longest document on; documents that
are still wanted alike stand together as one side of a pair, so that the longest one is decided against all shorter
ones, and what is left undecided is short wherever sizes allow. So whatever is left of a bucket of documents is at most one undecided document per source; these
residuals meet in a reduction tree, some buckets at a time, until one per source remains and is drawn by itself. The
words taken of a source then differ from its target by less than that one document, and every document is taken with
exactly the probability wanted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outbreak_spark.llm.common import Workspace

WORDS = r"[^\x20\x09-\x0D]+"
#: Documents per bucket of the first round, and buckets that meet in each later one.
BUCKET, FAN_IN = 16_384, 16


def source_targets(sizes: DataFrame, work: Workspace, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: source_size, target. Sources by code point, null last, weigh `weights`, repeating, and share
    `share` times all sizes; a target stops at `most` times its source's size, the excess going to the others by weight
    until none is above. Only sums reach the driver; the table has a row per source and is written once."""
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = work.write(table.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int"))), "sums")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, cap = 0.0, F.col("source_size") * F.lit(float(most))
    while True:  # each round stops at least one more source
        over = cap <= F.col("weight") * F.lit(level)
        row = table.agg(F.sum(F.when(over, cap)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if not row.weight:
            break
        new = (share * total - (row.full or 0.0)) / row.weight
        if new <= level:
            break
        level = new
    return table.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def round_pairs(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """0 or 1 for each document in turn; the index of the one left undecided (its p in place), or -1. Sizes descend."""
    p, draw = p.astype(float).copy(), rng.random(len(p))
    i, begin = -1, 0
    if len(p) and (p == p[0]).all():
        # A document against all after it, which share one p: mass moves until the document is decided.
        q, left = float(p[0]), float(size.sum())
        while begin < len(p) - 1:
            rest = left - size[begin]
            taken, not_taken = (q * left - size[begin]) / rest, q * left / rest
            if taken < 0 or not_taken > 1:  # it outweighs them: they are decided first, in pairs
                break
            p[begin] = float(draw[begin] < q)
            q, left, begin = taken if p[begin] else not_taken, rest, begin + 1
        p[begin:] = q
        if min(q, 1 - q) < 1e-12:
            p[begin:] = round(q)
            return p, -1
    for j in range(begin, len(p)):
        if i < 0:
            i = j
            continue
        a, b = size[i], size[j]
        up = min((1 - p[i]) * a, p[j] * b)  # words that may move from j to i
        down = min(p[i] * a, (1 - p[j]) * b)
        moved = up if draw[j] * (up + down) < down else -down
        full_i, full_j = (moved > 0 and up == (1 - p[i]) * a) or (moved < 0 and down == p[i] * a), (moved > 0 and up == p[j] * b) or (moved < 0 and down == (1 - p[j]) * b)
        p[i], p[j] = p[i] + moved / a, p[j] - moved / b
        if full_i:
            p[i] = round(p[i])
        if full_j:
            p[j] = round(p[j])
        if full_i and full_j:
            i = -1
        elif full_i:
            i = j
    return p, i


def round_bucket(size: np.ndarray, p: np.ndarray, key: np.ndarray, seed: int, source, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket's documents of one source, longest first: p after rounding, and which are decided: all if it's the last
    bucket, else all but one."""
    rng = np.random.default_rng([seed, int(hash_of(source)), len(p), abs(int(key[0]))])
    p, left = round_pairs(size, p, rng)
    done = np.ones(len(p), bool)
    if left >= 0 and last:
        p[left] = float(rng.random() < p[left])
    elif left >= 0:
        done[left] = False
    return p, done


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, columns: tuple[str, ...] = (), bucket_rows: int = BUCKET, fan_in: int = FAN_IN) -> DataFrame:
    """Copies of each document in the mix.

    docs needs doc_id, text and source; of other columns those named are carried along. Returns doc_id, source, size
    (words), source_size, target, copies, taken (copies * size), and the named columns. Null and empty texts have size
    0 and floor(r) copies; null sources are one source; null and repeated doc_ids are kept, each row a document.
    Reruns agree: documents are dealt to buckets by hash and ordered in them by size and hash. An empty table gives an
    empty result. Columns named like a column that mix uses are an error. bucket_rows: documents of a bucket of the
    first round; fan_in: buckets that meet in each later one.
    """
    used = {"doc_id", "source", "size", "source_size", "target", "copies", "taken", "p", "key", "bucket", "done"}
    if clash := set(columns) & used:
        raise ValueError(f"columns have names that mix uses: {sorted(clash)}")
    spark = docs.sparkSession
    work = Workspace(spark, "mix")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), *columns)
    rows = work.write(base, "sizes")
    targets = work.write(source_targets(rows, work, weights, share, most), "targets")
    count = rows.count()
    buckets = max(1, -(-count // bucket_rows))
    joined = rows.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")), "left")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    order = F.xxhash64(F.col("doc_id"), F.col("size"), F.lit(seed), *columns)
    joined = joined.select("d.*", "source_size", "target", F.floor(wanted).cast("long").alias("copies"), (wanted - F.floor(wanted)).alias("p"), order.alias("key"))
    joined = joined.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("long"))
    schema = joined.withColumn("done", F.lit(True)).schema

    def rounded(groups: list[str], last: bool):
        def run(key, table):
            pdf = table.select(["source", "size", "p", "key", "doc_id", "bucket"]).to_pandas()
            pdf["at"] = np.arange(len(pdf))
            pdf["copies"] = table.column("copies").to_numpy()
            pdf["done"] = True
            open_ = pdf[(pdf["p"] > 0) & (pdf["size"] > 0)].sort_values(["size", "key", "doc_id"], ascending=[False, True, True], kind="stable")
            copies, done, prob = pdf["copies"].to_numpy().copy(), np.ones(len(pdf), bool), pdf["p"].to_numpy(float).copy()
            for source, part in open_.groupby("source", dropna=False, sort=False):
                at = part["at"].to_numpy()
                prob[at], done[at] = round_bucket(part["size"].to_numpy(float), part["p"].to_numpy(float), part["key"].to_numpy(), seed, source, last)
                copies[at] += done[at] & (prob[at] > 0.5)
            out = table.set_column(table.schema.get_field_index("copies"), "copies", pa.array(copies, pa.int64()))
            out = out.set_column(out.schema.get_field_index("p"), "p", pa.array(np.where(done, 0.0, prob), pa.float64()))
            return out.append_column("done", pa.array(done, pa.bool_()))

        return run

    step, now, parts = 0, joined, []
    while True:
        last = buckets == 1
        groups = ["bucket"] if not step else ["source", "bucket"]
        now = work.write(now.groupBy(*groups).applyInArrow(rounded(groups, last), schema), f"round{step}")
        parts.append(now.where("done").drop("done"))
        if last:
            break
        buckets, step = -(-buckets // fan_in), step + 1
        now = now.where(~F.col("done")).drop("done").withColumn("bucket", F.floor(F.col("bucket") / fan_in).cast("long"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *columns)


def hash_of(source) -> int:
    import xxhash

    return 0 if source is None or pd.isna(source) else xxhash.xxh3_64_intdigest(str(source)) >> 1


def op7_pivotal_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
