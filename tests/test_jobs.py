"""The two jobs: runs over growing input, reruns, parts, edge cases, the command line, and their queries against SQL."""

import datetime
import json
import logging
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from jobs import deidentify, surveillance
from jobs.queries import QUERIES, SQL
from outbreak_spark.functions.privacy import strip_pii
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
TEXTS = ["call 555-123-4567 or mail a.b@c.org", "nothing to hide", None, "", "from 192.168.1.100, MRN: AB12345 " * 2000]


@pytest.fixture
def source(spark, tmp_path):
    """Copies: a table of documents as a folder that can grow, and one of conversations as a single file."""
    at = str(tmp_path / "in")
    docs = spark.createDataFrame([(k, TEXTS[k % 5], (f"src{k % 2}" if k % 3 else "007" if k else "") if k % 7 or not k else None) for k in range(20)], "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(f"{at}/documents.parquet")
    talk = spark.createDataFrame([(1, k, "user", TEXTS[k % 5]) for k in range(6)], "conv_id long, turn long, role string, text string")
    talk.coalesce(1).write.parquet(f"{at}/once")
    file = next(f for f in os.listdir(f"{at}/once") if f.endswith(".parquet"))
    shutil.move(f"{at}/once/{file}", f"{at}/conversations.parquet")
    return at, docs, talk


def written(spark, out):
    return sorted((r.kind, r.part, r.id, r.clean or "", tuple(r.types)) for r in deidentify.texts(spark, out).collect())


def wanted(*tables):
    """kind, part, id and text of each row, redacted by the operator at once."""
    rows = []
    for df, kind, name, part in tables:
        x = strip_pii(df, "text", "clean", "types").select(F.lit(kind).alias("k"), F.coalesce(F.nullif(part, F.lit("")), F.lit("none")).alias("p"), name.alias("i"), "clean", "types")
        rows += [(r.k, r.p, r.i, r.clean or "", tuple(r.types)) for r in x.collect()]
    return sorted(rows)


def test_stream_takes_only_what_is_new(spark, source, tmp_path, caplog):
    at, docs, talk = source
    out, seen = str(tmp_path / "out"), str(tmp_path / "seen")
    names = ((docs, "document", F.col("doc_id").cast("string"), F.col("source")), (talk, "conversation", F.concat_ws("-", "conv_id", "turn"), F.col("role")))
    with caplog.at_level(logging.INFO, "deidentify"):
        first = deidentify.run(spark, at, out, seen)
    assert [(b["read"], b["texts"]) for b in first] == [(26, 26)] and "read 26 rows" in caplog.text
    assert written(spark, out) == wanted(*names)
    files = sorted(f for _, _, fs in os.walk(out) for f in fs if f.startswith("part-"))
    assert deidentify.run(spark, at, out, seen) == []  # nothing new: nothing is written
    assert files == sorted(f for _, _, fs in os.walk(out) for f in fs if f.startswith("part-"))

    more = spark.createDataFrame([(100, "see https://x.org/p?q=1", "src9"), (100, "see https://x.org/p?q=1", "src9")], docs.schema)
    more.write.mode("append").parquet(f"{at}/documents.parquet")
    again = deidentify.run(spark, at, out, seen, {"max_files_per_trigger": 1})
    assert sum(b["read"] for b in again) == 2 and sum(b["texts"] for b in again) == 2 and sum(b["with_identifiers"] for b in again) == 2
    assert written(spark, out) == wanted((docs.unionByName(more), *names[0][1:]), names[1])
    assert {r.part for r in deidentify.texts(spark, out).where("kind = 'document'").select("part").distinct().collect()} == {"none", "007", "src0", "src1", "src9"}
    found = {(r.kind, r.part, r.type): r.texts for r in deidentify.findings(spark, out).collect()}
    assert found["document", "src9", "url"] == 2 and ("conversation", "user", "phone") in found


def test_stream_of_an_empty_table(spark, source, tmp_path):
    at, docs, _ = source
    empty = str(tmp_path / "empty")
    docs.limit(0).coalesce(1).write.parquet(f"{empty}/documents.parquet")
    table = {"documents": deidentify.DEFAULTS["tables"]["documents"]}
    assert deidentify.run(spark, empty, str(tmp_path / "o"), str(tmp_path / "c"), {"tables": table}) == []


def rows_of(spark, path):
    return sorted(map(repr, spark.read.parquet(path).collect()))


def test_analysis_reruns_and_replaces_parts(spark, tmp_path, caplog):
    out = str(tmp_path / "out")
    with caplog.at_level(logging.INFO, "surveillance"):
        told = surveillance.run(spark, DATA, out, {"buckets": 4})
    assert told["summary"] == 25 and told["reproduction"] > 0 and told["events"] == spark.read.parquet(f"{DATA}/events.parquet").count() and f"{told['events']} events" in caplog.text
    before = {name: rows_of(spark, f"{out}/{name}") for name in ("reproduction", "summary")}
    assert surveillance.run(spark, DATA, out, {"buckets": 4}) == told
    assert before == {name: rows_of(spark, f"{out}/{name}") for name in before}
    kept = {f for f in os.listdir(f"{out}/summary/pathogen=view") if f.startswith("part-")}
    surveillance.run(spark, DATA, out, {"buckets": 4, "pathogens": ["click"], "rapid_days": 1e9})
    assert kept == {f for f in os.listdir(f"{out}/summary/pathogen=view") if f.startswith("part-")}  # other parts are left alone
    now = spark.read.parquet(f"{out}/summary")
    assert now.count() == 25 and now.where("pathogen = 'click' and doubling_time > 0 and alert_level <> 'RED'").count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("daily_")]  # no table is left in the catalog


def test_analysis_shuffles_nothing_but_the_counts(spark, tmp_path):
    from outbreak_spark.sources import tables

    name = surveillance.bucketed(tables.from_events(spark, DATA), str(tmp_path / "daily"), 4)
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        daily = spark.table(name)
        for df in (surveillance.reproduction(daily), surveillance.summary(daily, datetime.date(2024, 2, 1), None)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Python" not in plan and "MapInArrow" not in plan
            assert df.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
        spark.sql(f"drop table {name}")


def test_analysis_of_nothing(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").limit(0).write.parquet(str(tmp_path / "in" / "events.parquet"))
    told = surveillance.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), {"buckets": 2})
    assert told == {"events": 0, "days": 0, "reproduction": 0, "summary": 0}


@pytest.mark.parametrize("job", ["deidentify", "surveillance"])
def test_command_line(tmp_path, source, job):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"tasks_per_part": 1} if job == "deidentify" else {"buckets": 2, "pathogens": ["click"]}))
    args = ["--config", str(config), "--input", source[0] if job == "deidentify" else DATA, "--output", str(tmp_path / "out")] + (["--checkpoint", str(tmp_path / "seen")] if job == "deidentify" else [])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"}
    done = subprocess.run([sys.executable, os.path.join(ROOT, "jobs", f"{job}.py"), *args], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert ("phone in" if job == "deidentify" else "summary: 5 rows") in done.stderr
    assert json.loads(open(os.path.join(ROOT, "jobs", f"{job}.json"), encoding="utf-8").read()) == (deidentify if job == "deidentify" else surveillance).DEFAULTS


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    duck, had = duckdb.connect(), spark.conf.get("spark.checkpoint.dir", None)
    for t in ("documents", "conversations", "events"):
        duck.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df, want = QUERIES[name](spark, DATA), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    norm = lambda r: tuple(round(v, 5) if isinstance(v, float) else v for v in r)
    assert sorted(map(norm, df.select(*want.columns).collect()), key=repr) == sorted(map(norm, want.fetchall()), key=repr)
    assert had is None or spark.conf.get("spark.checkpoint.dir") == had
