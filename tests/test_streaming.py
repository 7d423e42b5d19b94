import datetime
import os

import pytest
from outbreak_spark.model import KEYS
from outbreak_spark.operators import rt
from outbreak_spark.sources import tables
from outbreak_spark.streaming import online

DATA = "/root/testdata/sf0.001/events.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")


def run(spark, stream, name):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_counts_rt_and_changepoints(spark, tmp_path):
    rows = [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, hours=h), 0, "click") for d in range(30) for h in range(d % 5 + 3) for k in (d * 24 + h,)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").parquet(str(tmp_path / "in"))
    counts = run(spark, online.daily_counts(stream), "counts")
    assert counts and all(r.new_cases == (r.day.day - 1) % 5 + 3 for r in counts)

    (tmp_path / "daily").mkdir()
    daily = spark.createDataFrame([("r0", "click", datetime.date(2024, 1, 1) + datetime.timedelta(days=d), 10 + d) for d in range(40)], "region string, pathogen string, day date, new_cases long")
    daily.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "daily"))
    source = lambda: spark.readStream.schema(daily.schema).parquet(str(tmp_path / "daily"))
    got = {r.day: r.rt_mean for r in run(spark, online.stream_rt(source(), rt.weights_of("flu")), "rts")}
    batch = tables.cumulative(daily.selectExpr(*KEYS, "day as date", "new_cases", "0L as new_deaths", "1L as population"))
    want = {r.date: r.rt_mean for r in rt.posterior(batch, rt.weights_of("flu")).collect()}
    assert len(got) == 33 and all(abs(got[d] - want[d]) < 1e-9 for d in got)
    assert len(run(spark, online.stream_changepoints(source()), "changes")) == 40

    # Days without events count 0, as the calendar of a batch.
    (tmp_path / "gaps").mkdir()
    holes = daily.where("day(day) not in (11, 12, 25)")
    holes.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "gaps"))
    source = lambda: spark.readStream.schema(daily.schema).parquet(str(tmp_path / "gaps"))
    got = {r.day: r.rt_mean for r in run(spark, online.stream_rt(source(), rt.weights_of("flu")), "gapped")}
    batch = tables.cumulative(tables.calendar(holes.selectExpr(*KEYS, "day as date", "new_cases", "0L as new_deaths", "1L as population")))
    want = {r.date: r.rt_mean for r in rt.posterior(batch, rt.weights_of("flu")).collect()}
    assert set(got) == set(want) and len(got) == 33 and all(abs(got[d] - want[d]) < 1e-9 for d in got)
    assert len(run(spark, online.stream_changepoints(source()), "gapped_changes")) == 40


def test_late_days_go_aside_and_restarts_go_on(spark, tmp_path):
    """Files come one by one, the second with days of the first; the stream is started anew from its checkpoint for each."""
    day = lambda d: datetime.date(2024, 1, 1) + datetime.timedelta(days=d)
    schema = "region string, pathogen string, day date, new_cases long"
    rows = [("r0", "click", day(d), 10 + d) for d in range(40)]
    late = [("r0", "click", day(3), 99), ("r0", "click", day(19), 99)]
    for name, build in (("rt", lambda s: online.stream_rt(s, rt.weights_of("flu"))), ("changes", online.stream_changepoints)):
        at, out = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out")
        for part in (rows[:20], late, rows[20:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(at)
            q = build(spark.readStream.schema(schema).parquet(at)).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-seen").trigger(availableNow=True).start()
            q.awaitTermination(120)
        got = spark.read.parquet(out)
        assert sorted(r.day for r in got.where("late").collect()) == [day(3), day(19)]
        if name == "rt":
            batch = tables.cumulative(spark.createDataFrame(rows, schema).selectExpr(*KEYS, "day as date", "new_cases", "0L as new_deaths", "1L as population"))
            want = {r.date: r.rt_mean for r in rt.posterior(batch, rt.weights_of("flu")).collect()}
            mine = {r.day: r.rt_mean for r in got.where("not late").collect()}
            assert set(mine) == set(want) and all(abs(mine[d] - want[d]) < 1e-9 for d in want)
        else:
            assert got.where("not late").count() == 40
