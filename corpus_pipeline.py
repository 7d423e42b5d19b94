"""Corpus pipeline over `documents`: language ID, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each result as Parquet
into the shared folder and rereads it as the next stage's docs. All but the last return the columns of documents.
A document's repeated rows, if the mix takes it more than once, keep its doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outbreak_spark.llm import jaccard, langid, mixing, packing, suffix_dedup
from outbreak_spark.llm.common import KEY, Workspace, row_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the character models reject go: no letters, or letters in no learned language's order."""
    model = langid.train(docs.where(F.col("doc_id").isNotNull()))
    return langid.identify(docs, model, *COLUMNS[1:]).where(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links join, the document of the least doc_id stays (null last; of equal rows, one). Documents
    without words are in no group and stay."""
    work = Workspace(spark, "near")
    found = work.write(jaccard.similarity_components(docs), "found")
    first = found.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("f"))
    keys = first.select(F.col("f.row_key").alias(KEY)).join(found.groupBy(F.col("row_key").alias(KEY)).count(), KEY)
    keys = keys.unionByName(found.where("group is null").select(F.col("row_key").alias(KEY), F.lit(1).cast("long").alias("count")).distinct())
    kept = work.attach(docs.withColumn(KEY, row_key()), "keys", work.write(keys, "keys"), KEY, "inner")
    return kept.where("count = 1").unionByName(kept.where("count > 1").dropDuplicates([KEY])).select(*COLUMNS)


def without_halves(text):
    """The text without its invalid bytes. Replacement characters of its own are written as escapes meanwhile."""
    own = F.replace(F.replace(text, F.lit("\x01"), F.lit("\x01a")), F.lit("\ufffd"), F.lit("\x01b"))
    valid = F.replace(F.make_valid_utf8(own), F.lit("\ufffd"), F.lit(""))
    return F.replace(F.replace(valid, F.lit("\x01b"), F.lit("\ufffd")), F.lit("\x01a"), F.lit("\x01"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur again are cut from all texts; bytes of a character cut in two go with it."""
    out = suffix_dedup.remove_repeated_bytes(docs, 200, *COLUMNS[2:])
    whole = F.when(F.col("n_removed") > 0, without_halves(F.col("kept").cast("string"))).otherwise(F.col("kept").cast("string"))
    out = out.withColumn("text", whole).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one that it doesn't take goes. Rows that are equal in doc_id and text
    are taken alike."""
    work = Workspace(spark, "source")
    docs = docs.withColumn(KEY, row_key())
    out = mixing.mix(docs.select("doc_id", "text", "source", KEY), columns=(KEY,))
    copies = work.write(out.groupBy(KEY).agg(F.max("copies").cast("int").alias("copies")), "copies")
    taken = work.attach(docs, "copies", copies, KEY, "inner")
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 1024 ids."""
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), most_pieces=50_000)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mix", source_mix),
    ("packing", packed),
]

#: Iterative and randomised stages: tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.write(docs, f"stage{k}")
    return docs
