"""How filters of documents interact: what each removes, alone, after others, and in every order.

A relational pipeline. Words are exploded and counted by (document, word), then by document: totals and distinct words.
Flags of characters, of equal texts and of labels are joined to that. A document's failed filters are the bits of a mask;
per part, 3 x 2^filters conditional counts (all, good and toxic documents) say all there is to know, and every order of
the filters is arithmetic on those.

Documents are dealt once, by (doc_id, hash of the text, scan partition): the counts by word and by document need no other
exchange, and rows that repeat are spread. Minima of doc_id by text are combined before they're sent; the joins are
sort-merge joins whose hot keys (a text that very many documents have) Spark may split.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outbreak_spark.llm.common import text_bytes

#: White space that ends a word; bytes of text that a task counts words of.
SPACE, TASK_BYTES = r"[\x20\x09-\x0D]+", 64 << 20


def default_filters() -> dict[str, Column]:
    """Name -> whether a document fails, of the columns of features()."""
    c = F.col
    return {
        "A": c("words") < 50,
        "B": 100 * c("distinct") < 65 * c("words"),
        "C": 100 * c("capitals") > 5 * c("points"),
        "D": c("symbols"),
        "E": F.coalesce(c("first_id") < c("doc_id"), F.lit(False)),
    }


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, hash, words and distinct words, a row for each (doc_id, hash) of docs: doc_id, hash, text."""
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs) // TASK_BYTES))
    dealt = docs.withColumn("scan", F.spark_partition_id()).repartition(tasks, "doc_id", "hash", "scan")
    # A null after the words counts the rows, and keeps those without words.
    words = dealt.select("doc_id", "hash", "scan", F.explode(F.array_append(F.split("text", SPACE), F.lit(None).cast("string"))).alias("word"))
    by_word = words.where("word is null or word <> ''").groupBy("doc_id", "hash", "scan", "word").agg(F.count("*").alias("n"))
    rows, total = F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0))
    by_row = by_word.groupBy("doc_id", "hash", "scan").agg((total / rows).cast("long").alias("words"), F.count("word").alias("distinct"))
    return by_row.groupBy("doc_id", "hash").agg(F.max("words").alias("words"), F.max("distinct").alias("distinct"))


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, part, words and distinct ones, points (code points), capitals ([A-Z]), symbols (has
    any), first_id (least doc_id of the same text), good and toxic."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    same = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("same")
    flags = rows.select("doc_id", "part", "hash", same, F.length("text").alias("points"), F.regexp_count("text", F.lit("[A-Z]")).alias("capitals"), F.col("text").rlike("[#$%&*|]").alias("symbols"))
    first = rows.where("doc_id is not null").groupBy(same).agg(F.min("doc_id").alias("first_id"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counts = word_counts(rows.select("doc_id", "hash", "text")).select(F.col("doc_id").alias("id"), F.col("hash").alias("h"), "words", "distinct")
    out = flags.join(first.hint("merge"), "same", "left").join(marks.hint("merge"), "doc_id", "left")
    out = out.join(counts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")), "left")
    is_one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False)).alias(c)
    return out.select("doc_id", "part", "points", "capitals", "symbols", "first_id", "words", "distinct", is_one("good"), is_one("toxic"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    docs needs doc_id, source and text, labels doc_id, quality and toxic; other columns are ignored. filters: names of one
    character, and conditions on the columns of features(); a null condition passes. part is the source, null: empty. Null
    texts are empty. Each row is a document, repeated ones too, which aren't copies of themselves; a null doc_id is no
    smaller or larger than any, and has no labels. A document with several labels is good (toxic) if any says so. All
    (filters)! orders are listed, zeros included; empty docs give an empty result.
    """
    filters = default_filters() if filters is None else filters
    names = "".join(filters)
    masks = range(1 << len(names))
    bits = [F.when(F.coalesce(fails, F.lit(False)), 1 << k).otherwise(0) for k, fails in enumerate(filters.values())]
    each = features(docs, labels).select("part", "good", "toxic", sum(bits, F.lit(0)).alias("mask"))
    kinds = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counted = each.groupBy("part").agg(*(F.count_if((F.col("mask") == m) & which).alias(f"{kind}{m}") for kind, which in kinds.items() for m in masks))
    cube = counted.select("part", *(F.array(*(f"{kind}{m}" for m in masks)).alias(kind) for kind in kinds))

    orders = F.split(F.lit(",".join(map("".join, itertools.permutations(names)))), ",")
    rows = cube.select("*", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.transform(F.split("filter_order", ""), lambda x: F.pow(F.lit(2), F.instr(F.lit(names), x) - 1).cast("int")).alias("bits"), F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    rows = rows.select("*", total(F.slice("bits", F.lit(1), F.col("step") - 1)).alias("before"), F.element_at("bits", F.col("step")).alias("bit"), F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"))

    def documents(kind: str, condition) -> Column:
        """How many have a mask that meets the condition."""
        return F.aggregate(F.zip_with(F.lit(list(masks)), kind, lambda m, n: F.when(condition(m), n).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, n: a + n)

    fails, earlier = lambda m: m.bitwiseAND(F.col("bit")) != 0, lambda m: m.bitwiseAND(F.col("before")) != 0
    lost = lambda m: fails(m) & ~earlier(m)
    out = rows.select(
        "part", "filter_order", "step", "filter", documents("all", lambda m: ~fails(m) & ~earlier(m)).alias("kept"), documents("all", lost).alias("removed"), documents("all", lambda m: fails(m) & earlier(m)).alias("redundant"),
        F.element_at("all", F.col("bit") + 1).alias("unique_fails"), documents("good", lost).alias("good_lost"), documents("toxic", lost).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return audit(read("documents"), read("labels"))


OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), f AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d
), l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1
), b AS (
  SELECT part, (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN first_id < doc_id THEN 16 ELSE 0 END) AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id)
), c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM b GROUP BY 1, 2
), o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(filter_order, x)
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS filter, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
    coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k, 1)) - 65))), 0)::BIGINT AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step) r WHERE length(filter_order) = 5
), e AS (
  SELECT part, filter_order, step, filter, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step::INTEGER AS step, filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM e
"""
