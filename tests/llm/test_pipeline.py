import corpus_pipeline
import pytest
from outbreak_spark.llm import jaccard, suffix_dedup
from outbreak_spark.llm.common import Workspace
from outbreak_spark.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F


def test_a_query_per_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 13)) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    words = lambda k, n: " ".join(f"{w}{(k * 7919 + i * 31) % 9973}x" for i in range(n) for w in ("lorem",))
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [words(k, 60 + k).translate(letters) for k in range(20)]
    texts += [texts[0], texts[1] + " tail", None, "12 34"]
    passage = words(99, 60).translate(letters)
    texts += [f"{words(200 + k, 40).translate(letters)} {passage} {words(300 + k, 40).translate(letters)}" for k in range(3)]
    rows = [(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_stages(spark, small):
    path, rows = small
    work = Workspace(spark, "test")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = work.write(corpus_pipeline.language_id(spark, docs, path), "0")
    assert {r.doc_id for r in kept.collect()} == {k for k, t, *_ in rows if t and any(c.isalpha() for c in t)} and kept.columns == docs.columns
    unique = work.write(corpus_pipeline.near_duplicates(spark, kept, path), "1")
    least = {r.component_id for r in jaccard.similarity_components(kept).collect()}
    assert sorted(r.doc_id for r in unique.collect()) == sorted(least) and 20 not in least
    cut = work.write(corpus_pipeline.repeated_passages(spark, unique, path), "2")
    want = {r.doc_id: r.kept for r in suffix_dedup.remove_repeated_bytes(unique).collect()}
    assert {r.doc_id: r.text.encode() for r in cut.collect()} == {k: v.decode(errors="ignore").encode() for k, v in want.items()} and cut.columns == docs.columns
    mixed = work.write(corpus_pipeline.source_mix(spark, cut, path), "3")
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().where("count > 2").count() == 0
    out = corpus_pipeline.packed(spark, mixed, path)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in mixed.collect()}


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small[0]).count() > 0


def test_own_replacement_characters_stay(spark):
    half = "é漢".encode()
    texts = ["a\ufffdb\x01\ufffd\x01a\x01b\x01".encode(), b"x" + half[:-1] + "\ufffd".encode() + half[1:] + b"\x01", half[1:2] + b"ok" + half[:1], b"\x01" + half[3:] + b"ab"]
    rows = spark.createDataFrame(list(enumerate(map(bytearray, texts))), "k int, kept binary")
    got = rows.select("k", corpus_pipeline.without_halves(F.col("kept").cast("string")).alias("t")).orderBy("k").collect()
    assert [r.t for r in got] == [t.decode(errors="ignore") for t in texts]
