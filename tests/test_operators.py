import datetime
import math

import numpy as np
import pytest
from outbreak_spark.functions import privacy, quantiles
from outbreak_spark.functions.expressions import alert_level, iso_date, phase, quality_gate, seir_periods, wilson
from outbreak_spark.kernels import epidemic
from outbreak_spark.kernels.gamma import chi2_quantile, gamma_cdf, gamma_quantile
from outbreak_spark.kernels.trees import Booster
from outbreak_spark.model import RECORD, serial_interval
from outbreak_spark.operators import changepoint, explain, features, forecast, metrics, ordered, quality, report, rt, seir
from outbreak_spark.sources import records, synthetic, tables
from pyspark.sql import functions as F

DAY = datetime.date(2024, 1, 1)


def frame(spark, cases, region="r", **more):
    rows = [(region, "p", k, DAY + datetime.timedelta(days=k), c, *(v for v in more.values())) for k, c in enumerate(cases)]
    extra = "".join(f", {k} long" for k in more)
    return spark.createDataFrame(rows, "region string, pathogen string, record_index long, date date, new_cases long" + extra)


def record(k=0, **more):
    base = {"record_index": k, "date": "2024-01-15", "region": "test_region", "pathogen": "test_pathogen", "new_cases": 100, "cumulative_cases": 500, "new_deaths": 2, "cumulative_deaths": 10, "population": 1_000_000, "source": "test", "metadata": {}}
    return tuple((base | more)[f.name] for f in RECORD.fields)


def checked(spark, rows, **options):
    df = spark.createDataFrame(rows, RECORD)
    found = quality.issues(df, as_of=datetime.date(2024, 6, 1), **options)
    return df, found, quality.report(df, found).first()


def test_valid_records_score_high(spark):
    rows = [record(k, date=f"2024-01-{k + 1:02d}", new_cases=101 + k, cumulative_cases=101 * (k + 1) + 100) for k in range(14)]
    _, found, r = checked(spark, rows)
    assert r.is_acceptable and r.quality_score > 0.8 and r.valid_records == 14


@pytest.mark.parametrize(
    ("change", "severity", "field"),
    [({"new_cases": -500}, "error", "new_cases"), ({"new_cases": 5, "new_deaths": 100}, "warning", "new_deaths"), ({"population": 0}, "error", "population"), ({"population": None}, "error", "population"), ({"date": ""}, "error", "date"), ({"date": None}, "error", "date"), ({"date": "2024-13-01"}, "error", "date"), ({"date": "2024-1-5"}, "error", "date"), ({"date": "2025-01-01"}, "warning", "date"), ({"cumulative_cases": 1}, "warning", "cumulative_cases")],
)
def test_single_checks(spark, change, severity, field):
    _, found, r = checked(spark, [record(**change)])
    assert (severity, field) in [(i.severity, i.field) for i in found.collect()]
    assert severity == "warning" or r.quality_score <= 0.5


def test_zero_cases_with_deaths_is_no_issue(spark):
    assert checked(spark, [record(new_cases=0, new_deaths=3, date="20240115")])[1].count() == 0


def test_looking_back(spark):
    rows = [record(k, date=f"2024-01-0{k + 1}", new_cases=n, cumulative_cases=c) for k, (n, c) in enumerate([(100, 10_000), (100, 20_000), (5000, 15_000), (100, None), (100, 12_000)])]
    found = checked(spark, rows)[1].collect()
    assert [(i.record_index, i.field) for i in found if i.check == "spike"] == [(2, "new_cases")]
    assert [(i.record_index, i.field) for i in found if i.check == "falling_total"] == [(2, "cumulative_cases")]  # the null breaks the chain


def test_series_are_apart_unless_asked(spark):
    rows = [record(0, region="a", new_cases=1), record(1, region="b", new_cases=500)]
    assert not [i for i in checked(spark, rows)[1].collect() if i.check == "spike"]
    assert [i for i in checked(spark, rows, partitioned=False)[1].collect() if i.check == "spike"]


def test_empty_records(spark):
    _, found, r = checked(spark, [])
    assert (r.quality_score, r.is_acceptable, r.errors, r.total_records) == (0.0, False, 1, 0)


def test_filter_keeps_valid(spark):
    df, found, _ = checked(spark, [record(0), record(1, new_cases=-50), record(2, new_cases=200)])
    assert [r.record_index for r in quality.valid_records(df, found).orderBy("record_index").collect()] == [0, 2]


STRIPPED = [
    ("Seen by Dr. Jane Doe today", ["name"], "Seen by [REDACTED_NAME]"),
    ("lives at 12 Oak Hill Road now", ["address"], "lives at [REDACTED_ADDRESS] now"),
    ("on 01/15/2024", ["date_mmddyyyy"], "on [REDACTED_DATE]"),
    ("on January 5, 2024", ["date_text"], "on [REDACTED_DATE]"),
    ("call (555) 123-4567", ["phone"], "call ([REDACTED_PHONE]"),
    ("fax: 555-123-4567", ["phone"], "fax: [REDACTED_PHONE]"),
    ("mail a.b@c.org", ["email"], "mail [REDACTED_EMAIL]"),
    ("SSN 123-45-6789", ["ssn"], "SSN [REDACTED_SSN]"),
    ("MRN: AB12345", ["mrn"], "[REDACTED_MRN]"),
    ("MRN: 1234567", ["phone"], "MRN: [REDACTED_PHONE]"),
    ("Member ID: XK99201", ["health_plan_id"], "[REDACTED_HEALTH_PLAN_ID]"),
    ("Acct No: 12345678", ["phone"], "Acct No: [REDACTED_PHONE]"),
    ("License No: CA-77812", ["zip_code"], "License No: CA-[REDACTED_ZIP]"),
    ("VIN 1HGCM82633A004352", ["vin"], "VIN [REDACTED_VIN]"),
    ("see https://x.org/p?q=1", ["url"], "see [REDACTED_URL]"),
    ("from 192.168.1.100", ["ip_address"], "from [REDACTED_IP]"),
    ("a fingerprint match", ["biometric"], "a [REDACTED_BIOMETRIC] match"),
    ("jane_photo.jpg", ["photo_file"], "[REDACTED_PHOTO]"),
    ("Patient ID: P-001", ["unique_id"], "[REDACTED_ID]"),
    ("2024-01-15", [], "2024-01-15"),
    ("influenza cases: 500", [], "influenza cases: 500"),
    (None, [], None),
]


def test_redaction(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(STRIPPED)], "k int, text string")
    got = privacy.strip_pii(df, "text", "clean", "types").orderBy("k").collect()
    assert [(r.types, r.clean) for r in got] == [(n, c) for _, n, c in STRIPPED]
    found = df.select("k", privacy.pii_counts(F.col("text")).alias("n"), privacy.pii_matches(F.col("text")).alias("m")).orderBy("k").collect()
    assert set(found[5].n) == {"phone", "fax"} and found[21].n == {} and found[6].m[0].match == "a.b@c.org"


def test_metadata_is_seen_and_redacted(spark):
    df = spark.createDataFrame([record(metadata={"note": "mail a.b@c.org"})], RECORD)
    assert privacy.audit(df).first().pii_types_found == ["email"]
    r = privacy.strip_records(df).first()
    assert r.metadata == {"note": "mail [REDACTED_EMAIL]"} and r.pii_types == ["email"] and r.items_redacted == 1


def test_schema_errors(spark):
    good = '{"date":"2024-01-15","region":"r","pathogen":"p","new_cases":5,"population":10}'
    rows = [(0, good), (1, '{"date":"2024-01-15"}'), (2, good.replace("5,", '"five hundred",')), (3, "[1]"), (4, good.replace("5,", "true,"))]
    df = spark.createDataFrame(rows, "k int, j string")
    got = [r[0] for r in df.orderBy("k").select(privacy.schema_errors(F.col("j"), F.col("k"))).collect()]
    assert [len(e) for e in got] == [0, 4, 1, 1, 0]
    assert len(df.where("k = 4").select(privacy.schema_errors(F.col("j"), F.col("k"), strict=True)).first()[0]) == 1


def test_hash_depends_on_values_only(spark):
    h = lambda cases, parts: privacy.dataset_hash(frame(spark, cases).repartition(parts), ["new_cases"], ["region", "record_index"]).first().data_hash
    assert h([100, 2], 1) == h([100, 2], 3) != h([101, 2], 1) and len(h([1], 1)) == 64
    two = lambda *rows: privacy.dataset_hash(spark.createDataFrame(rows, "a string, b string, i int"), ["a", "b"], ["i"]).first().data_hash
    every = [two(("a|b", "c", 1)), two(("a", "b|c", 1)), two(("ab", "c", 1)), two((None, "c", 1)), two(("\\N", "c", 1)), two(("-", "c", 1)), two(("a", "c", 1), ("a", "c", 2)), two(("a", "c", 1), ("a", "c", 1))]
    assert len(set(every)) == len(every)
    assert len(privacy.python_hash([{"cases": 100}])) == 64


def test_serial_interval():
    w = serial_interval(4.7, 2.9)
    assert len(w) == 21 and w[0] == 0 and abs(sum(w) - 1) < 1e-12
    with pytest.raises(ValueError):
        serial_interval(-1, 1)


def test_rt_of_growth_and_silence(spark):
    rng = np.random.default_rng(42)
    cases = [max(1, int(10 * 2.5 ** (t / 4.7) ** 1.0 * 0 + 10 * math.exp(0.1 * t) + rng.normal())) for t in range(60)]
    out = rt.estimate_rt(frame(spark, cases), rt.weights_of("covid-19")).orderBy("record_index").collect()
    assert len(out) == 60 - 7 and 0.5 < out[-1].rt_mean < 5 and out[-1].rt_lower < out[-1].rt_mean < out[-1].rt_upper and out[-1].phase == "growing"
    quiet = rt.estimate_rt(frame(spark, [0] * 20), rt.weights_of("flu")).collect()
    assert all(r.rt_mean is None and r.phase == "unknown" for r in quiet)


def test_gamma_quantiles():
    assert abs(gamma_quantile(0.025, [101], 0.01)[0] - 0.8226615879) < 1e-9
    assert abs(chi2_quantile(0.975, [10])[0] - 20.4831773508) < 1e-9
    a = np.array([0.3, 1, 5, 100, 1e4, 1e6])
    for p in (0.025, 0.5, 0.975):
        assert np.allclose(gamma_cdf(a, gamma_quantile(p, a, 1.0)), p, atol=1e-9)
    assert np.isnan(gamma_quantile(0.5, [np.nan, -1], 1.0)).all()


def test_metrics(spark):
    df = spark.createDataFrame([(15, 1000), (0, 0), (11, 10)], "d long, c long").select("c", wilson(F.col("d"), F.col("c")).alias("w"))
    got = {r.c: r.w for r in df.collect()}
    assert got[1000].value == 0.015 and got[1000].lower_ci < 0.015 < got[1000].upper_ci
    assert got[0].value is None and (got[10].lower_ci, got[10].upper_ci) == (0.0, 1.0)
    i = metrics.incidence_rate(spark.createDataFrame([(500, 1_000_000), (0, 1_000_000)], "cases long, population long")).collect()
    assert i[0].incidence.value == 50 and i[0].incidence.lower_ci < 50 < i[0].incidence.upper_ci
    assert i[1].incidence.lower_ci == 0 and abs(i[1].incidence.upper_ci - -math.log(0.025) / 10) < 1e-9


def test_bad_series_dont_stop_others(spark):
    rows = spark.createDataFrame([("a", 50, 1, 1000), ("b", 5, 1, 0), ("c", -5, 1, 1000), ("d", 5, -1, None)], "k string, cases long, deaths long, population long")
    got = {r.k: r for r in metrics.incidence_rate(metrics.attack_rate(metrics.case_fatality(rows))).collect()}
    assert got["a"].error is None and got["a"].incidence.lower_ci < 5000 < got["a"].incidence.upper_ci and got["a"].cfr.value == 0.02
    assert got["b"].attack_rate is None and got["b"].incidence.value is None and got["b"].incidence.upper_ci is None and "population" in got["b"].error and got["b"].cfr.value == 0.2
    assert got["c"].cfr is None and "negative" in got["c"].error and got["d"].cfr is None and got["d"].incidence.value is None
    s = spark.createDataFrame([("a", 2.0, 5.0, 3.0, 1e5, 1.0, 5), ("b", 2.0, 0.0, 3.0, 1e5, 1.0, 5), ("c", 2.0, 5.0, 3.0, None, 1.0, 5), ("d", 2.0, 5.0, 3.0, 1e5, 1.0, None)], "scenario_id string, r0 double, latent_days double, infectious_days double, population double, initial_infected double, t_max int")
    out = seir.seir_curves(s).collect()
    assert sorted((r.scenario_id, r.day is None, r.error is None) for r in out) == sorted([("a", False, True)] * 6 + [(k, True, False) for k in "bcd"])
    good = [3 * k + 5 for k in range(12)]
    rows = frame(spark, good, population=1000).unionByName(frame(spark, good, "zero", population=0)).unionByName(frame(spark, [None, *good[1:]], "hole", population=1000)).unionByName(frame(spark, [None] * 12, "null", population=1000))
    fits = {r.region: r for r in seir.fit_seir(rows).collect()}
    assert fits["r"].error is None and fits["hole"].error is None and fits["hole"].rmse is not None and (fits["zero"].r0, fits["null"].r0) == (None, None) and fits["zero"].error and fits["null"].error


def test_weights_by_pathogen(spark):
    rows = frame(spark, [k * k % 23 + 1 for k in range(40)])
    for name, known in (("FLU", "influenza"), ("Measles", "measles"), ("covid", "covid-19"), ("other", "covid-19")):
        own = rows.withColumn("pathogen", F.lit(name))
        a, b = (sorted((r.record_index, r.rt_mean) for r in rt.posterior(own, *w).collect()) for w in ((), (rt.weights_of(known),)))
        assert a == b


def test_first_issues_and_validation(spark):
    rows = [record(k, new_cases=-1 if k % 2 else 100, population=None if k == 3 else 1000, date="2024-01-15") for k in range(60)]
    r = quality.validation(spark.createDataFrame(rows, RECORD), as_of=datetime.date(2024, 6, 1)).first()
    assert r.total_records == 60 and len(r.issues) == 20 and [(i.record_index, i.check) for i in r.issues[:4]] == [(1, "negative"), (3, "negative"), (3, "population"), (5, "negative")]
    r = quality.validation(spark.createDataFrame([], RECORD)).first()
    assert [(i.record_index, i.check, i.severity) for i in r.issues] == [(-1, "empty", "error")]
    holes = spark.createDataFrame([record(k, date=None, region=None) for k in range(3)], RECORD)
    assert (-1, "incomplete") in [(i.record_index, i.check) for i in quality.validation(holes).first().issues]


def test_changepoint_summary_and_tail(spark):
    out = changepoint.changepoints(frame(spark, [10] * 50 + [1000] * 50), threshold=0.005)
    r = changepoint.summary(out).first()
    assert r.changepoints == 100 and r.indices == list(range(100)) and r.drops == 1 and abs(r.max_prob - 0.01) < 1e-6
    a, b = changepoint.RunLengths(), changepoint.RunLengths(tail=0)
    for k in range(300):
        x, y = (s.step(math.sin(k) + (k > 150) * 5) for s in (a, b))
        assert x[1] == y[1] and abs(x[2] - y[2]) < 1e-6
    assert len(b.p) == 301


def test_panels_and_dashboard(spark, tmp_path):
    daily = frame(spark, [k % 7 + 5 for k in range(90)], population=1000).withColumn("cumulative_cases", F.col("new_cases")).withColumn("new_deaths", F.lit(0).cast("long"))
    now, out = rt.estimate_rt(daily), changepoint.changepoints(daily, threshold=0.005)
    assert report.rt_panel(now).count() == 30 and report.changepoint_overlay(daily, out.where("record_index < 95")).count() == 90
    curve = seir.seir_curves(spark.createDataFrame([("a", 2.0, 5.0, 3.0, 1e5, 1.0, 100)], "scenario_id string, r0 double, latent_days double, infectious_days double, population double, initial_infected double, t_max int"))
    assert report.model_overlay(daily, curve).count() == 60
    drivers = spark.createDataFrame([("r", "p", "lag_1", 2.5, 1, "a<b")], "region string, pathogen string, feature string, importance double, rank int, label string")
    f = forecast.forecast(daily, horizon=7)
    assert report.forecast_panel(daily, f).where("kind = 'history'").count() == 60
    page = report.dashboard(daily, metrics.epi_metrics(daily), "r", "p", rt=now, forecasts=f, drivers=drivers, changes=out, curve=curve, path=str(tmp_path / "p.html"), points=30)
    assert all(f"<h2>{x}" in page for x in ("Daily cases", "Likeliest changes", "Reproduction", "Model", "Forecast", "Drivers")) and "a&lt;b" in page and (tmp_path / "p.html").read_text() == page
    assert report.dashboard(daily, metrics.epi_metrics(daily), "x", "p") == ""



def test_identifiers_as_their_sql_finds_them(spark):
    """Beside letters with accents, vertical tabs and letters of a third case, as DuckDB's RE2 sees them."""
    import duckdb
    from outbreak_spark.plans.oracle import COUNTS, _redact

    texts = ["ö1HGBH41JXMN109186ß und", "é555-123-4567è", "\u017fubject ID: abc12", "MRN:\x0b12345678", "Dr\x0bAda Lovelace", "mail \u212aim@ö.example.org or ö.a@b.cd", "https://x.org/ö\u017f\x0by z", "ü10.0.0.1ü", "Dr. Ädam Béa, Mr. Max Mußter", "x 1HGBH41JXMN10918\u212a", "ärzte_photo.png", None, ""]
    rows = [(str(k), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE x (id VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?, ?)", rows)
    own = "y AS (SELECT 1)"
    want = sorted(con.execute(f"WITH {COUNTS[COUNTS.index('n AS ('):]} SELECT id, type, n FROM n WHERE n > 0").fetchall())
    got = sorted(tuple(r) for r in df.select("id", F.explode(privacy.pii_counts(F.col("text")))).collect())
    assert got == want and len(want) > 5
    want = sorted(con.execute(_redact(own)).fetchall())
    got = sorted(tuple(r) for r in privacy.strip_pii(df, "text", "clean", "types").select("id", "clean", F.array_join("types", ",")).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got if r[1] is not None] == [r[2] for r in want if r[1] is not None]


def test_pii_spans(spark):
    texts = ["mail a.b@c.org or 555-123-4567, fax: 555-123-4567", "é 😀 x@y.io", "", None, "\x01 see 10.0.0.1"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select("k", privacy.pii_spans(F.col("t")).alias("s"), privacy.pii_matches(F.col("t")).alias("m")).orderBy("k").collect()
    assert got[0].s and got[1].s and got[4].s and not got[2].s and not got[3].s
    units = lambda t: "".join(t)
    for r, t in zip(got, texts, strict=True):
        assert [(x.name, x.match) for x in r.s] == [(x.name, x.match) for x in r.m]
        assert all(units(t)[x.start : x.end] == x.match for x in r.s)


def test_growth(spark):
    g = metrics.growth(frame(spark, [round(100_000 * math.exp(0.1 * t)) for t in range(14)])).first()
    assert abs(g.growth_rate - 0.1) < 1e-3 and abs(g.doubling_time - math.log(2) / 0.1) < 0.1
    g = metrics.growth(frame(spark, [100, 90, 80, 70, 60, 50, 40])).first()
    assert g.growth_rate < 0 and g.doubling_time is None
    assert metrics.growth(frame(spark, [5, 0, 0, 0, 0, 0, 3])).first().growth_rate is None


def test_changepoints(spark):
    out = changepoint.changepoints(frame(spark, [10] * 50 + [1000] * 50 + [10] * 50)).orderBy("record_index").collect()
    assert [r.record_index for r in out if r.run_dropped] == [50, 100]
    assert all(abs(r.changepoint_prob - 0.01) < 1e-6 and not r.is_changepoint for r in out)
    assert not [r for r in changepoint.changepoints(frame(spark, [10] * 50)).collect() if r.run_dropped]


def test_lag_features(spark):
    out = features.lag_features(frame(spark, list(range(100))), n_lags=7)
    assert out.count() == 93 and [c for c in out.columns if c.startswith("lag_")] == [f"lag_{k}" for k in range(1, 8)]
    full = features.lag_features(frame(spark, [3 * k % 11 for k in range(40)])).orderBy("record_index").toPandas()
    dates = [DAY + datetime.timedelta(days=k) for k in range(40)]
    assert np.allclose(full[features.feature_names()].to_numpy(float), forecast.table(np.array([3 * k % 11 for k in range(40)], float), dates, 14))


def test_forecast_and_ensemble(spark):
    rng = np.random.default_rng(1)
    cases = [int(100 + 50 * math.sin(2 * math.pi * k / 30) + rng.normal(0, 5)) for k in range(120)]
    out = forecast.forecast(frame(spark, cases), horizon=7)
    rows = out.collect()
    assert len(rows) == 14 and all(r.lower <= r.predicted <= r.upper and r.lower >= 0 for r in rows)
    both = forecast.ensemble(out).orderBy("step").collect()
    assert [r.step for r in both] == list(range(1, 8)) and both[0].model == "Ensemble (trees + weekly)"
    assert forecast.forecast(frame(spark, list(range(10)))).count() == 0


def test_shapley_adds_up(spark):
    f = features.lag_features(frame(spark, [k % 7 * 10 + k for k in range(60)]))
    phi = explain.shapley_values(f, trees=10)
    sums = phi.groupBy("row").agg(F.sum("phi").alias("s"), F.first("prediction").alias("p"), F.first("base").alias("b")).collect()
    assert all(abs(r.s + r.b - r.p) < 1e-6 for r in sums)
    top = explain.drivers(phi, 5)
    assert top.count() == 5 and "Main drivers" in explain.narrative(top).first().narrative


def test_shapley_by_brute_force():
    from itertools import combinations
    from math import factorial

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    model = Booster(trees=3, depth=3, rows=1.0, features=1.0, least=1).fit(x, x[:, 0] * 2 + x[:, 1] * x[:, 2])

    def value(tree, k, row, known):
        if tree.feature[k] < 0:
            return tree.value[k]
        a, b = tree.left[k], tree.right[k]
        if tree.feature[k] in known:
            return value(tree, a if row[tree.feature[k]] <= tree.cut[k] else b, row, known)
        return (tree.cover[a] * value(tree, a, row, known) + tree.cover[b] * value(tree, b, row, known)) / tree.cover[k]

    got = model.shapley(x[:3])
    for r in range(3):
        for i in range(4):
            others = [j for j in range(4) if j != i]
            want = sum(factorial(len(s)) * factorial(3 - len(s)) / 24 * (value(t, 0, x[r], {*s, i}) - value(t, 0, x[r], set(s))) for t in model.trees for n in range(4) for s in combinations(others, n))
            assert abs(got[r, i] - want) < 1e-9


def test_seir(spark):
    c = seir.curves_of(2.5, 5.2, 2.9, 1e6, 10, 365)[:, :, 0]
    assert np.allclose(c[:, :4].sum(1), 1e6, atol=1) and c[-1, 3] / 1e6 > 0.5
    assert seir.curves_of(0.8, 5, 3, 1e5, 100, 365)[-1, 2, 0] < 1
    assert seir.curves_of(5.0, 5, 3, 1e5, 10, 200)[:, 2, 0].argmax() < seir.curves_of(1.5, 5, 3, 1e5, 10, 365)[:, 2, 0].argmax()
    with pytest.raises(ValueError):
        seir.curves_of(2.0, -1, 3, 1e5, 1, 10)
    seir.register(spark)
    assert spark.sql("select * from seir(5.0, 5.0, 3.0, 100000.0, 0.0, 10)").agg(F.sum("incidence")).first()[0] == 0


def test_fit(spark):
    true = seir.curves_of(2.0, 5, 3, 5e5, 10, 119)[:, 4, 0]
    rows = frame(spark, [int(v) for v in true], population=500_000)
    got = seir.fit_seir(rows, guess=(3.0, 7.0, 5.0)).first()
    assert abs(got.r0 - 2.0) < 1.0 and got.r_squared > 0.5
    assert seir.fit_seir(frame(spark, [1, 2, 3], population=1000)).first().r0 is None


def test_synthetic(spark):
    s = synthetic.scenarios(spark, [{"pathogen": "COVID", "start_date": DAY, "duration_days": 60}])
    a, b = (synthetic.generate_epidemic(s).orderBy("record_index").collect() for _ in range(2))
    assert a == b and len(a) == 61 and a[-1].cumulative_cases == sum(r.new_cases for r in a)
    with pytest.raises(ValueError):
        synthetic.scenarios(spark, [{"pathogen": "unknown", "start_date": DAY}])
    assert synthetic.generate_multi_wave(s).count() == 61


def test_records_and_payload(spark, tmp_path):
    df = spark.createDataFrame([('[{"date":"2024-01-01","new_cases":3},{"date":"2024-01-02"}]',)], "j string")
    assert [(r.record_index, r.new_cases) for r in records.parse_records(df, "j").collect()] == [(0, 3), (1, None)]
    (tmp_path / "p.json").write_text('{"result":1,"message":"ok","epidata":[{"epiweek":202352,"region":"nat","num_ili":7}]}')
    (tmp_path / "q.json").write_text('{"result":-2,"message":"no","epidata":null}')
    got = records.read_payload(spark, str(tmp_path)).collect()
    assert [(r.date, r.new_cases, r.population) for r in got] == [("2023-12-30", 7, 330_000_000)]
    weeks = spark.createDataFrame([(202301,), (201501,), (202360,)], "w int")
    assert [str(r[0]) for r in weeks.select(records.epiweek_to_date(F.col("w"))).collect()] == ["2023-01-07", "2015-01-10", "None"]
    assert str(weeks.select(records.epiweek_to_date(F.col("w"), legacy=True)).collect()[1][0]) == "2015-01-03"


def test_expressions(spark):
    df = spark.createDataFrame([(0.5, 0.4, 0.6), (0.9, 0.8, 1.1), (1.2, 1.1, 1.3), (2.0, 1.5, 2.5), (None, None, None)], "r double, a double, b double")
    got = df.select(alert_level(F.col("r")), phase(F.col("a"), F.col("b")), quality_gate(F.col("r"))).collect()
    assert [r[0] for r in got] == ["GREEN", "YELLOW", "ORANGE", "RED", None] and [r[1] for r in got] == ["declining", "stable", "growing", "growing", "unknown"]
    assert got[0][2] == "CONDITIONAL"
    dates = spark.createDataFrame([("2024-01-15",), ("20240115",), ("2024-1-5",), ("2024-01-15T10:00:00",), ("x",)], "t string")
    assert [str(r[0]) for r in dates.select(iso_date(F.col("t"))).collect()] == ["2024-01-15", "2024-01-15", "None", "2024-01-15", "None"]
    p = df.limit(1).select(seir_periods(F.lit(0.5), F.lit(0.0), F.lit(0.25)).alias("p")).first().p
    assert p.r0 == 2 and p.latent_days == float("inf")


@pytest.mark.parametrize("parts", [1, 5])
def test_partitioning_does_not_matter(spark, parts):
    rows = frame(spark, [k * k % 23 for k in range(50)]).repartition(parts)
    got = rt.posterior(rows, rt.weights_of("flu")).agg(F.round(F.sum("rt_mean"), 9), F.count("*")).first()
    assert got == rt.posterior(frame(spark, [k * k % 23 for k in range(50)]).coalesce(1), rt.weights_of("flu")).agg(F.round(F.sum("rt_mean"), 9), F.count("*")).first()


def test_calendar_fills_gaps(spark):
    rows = spark.createDataFrame([("r", "p", DAY, 3, 1, 10), ("r", "p", DAY + datetime.timedelta(days=3), 4, 0, 10)], "region string, pathogen string, date date, new_cases long, new_deaths long, population long")
    assert [r.new_cases for r in tables.calendar(rows).orderBy("date").collect()] == [3, 0, 0, 4]


def test_fit_goes_on_until_it_converges(spark):
    got = seir.fit_seir(frame(spark, [round(100 - 99 * k / 29) for k in range(30)], population=100_000)).first()
    assert abs(got.infectious_days - 0.6537) < 0.01 and abs(got.r0 - 0.9525) < 0.01


def test_fits_in_lock_step_equal_fits_alone():
    rng = np.random.default_rng(5)
    series = [np.round(seir.curves_of(r0, 5, 3, 1e5, 10, days - 1)[:, 4, 0] + rng.integers(0, 3, days)) for r0, days in ((1.5, 40), (2.5, 60), (3.5, 25), (0.9, 30))]
    longest = max(map(len, series))
    seen, known = (np.array([np.pad(x, (0, longest - len(x))) for x in xs]) for xs in (series, [np.ones(len(x), bool) for x in series]))
    together = seir.fit_together(seen, known, np.full(4, 1e5), (2.5, 5.2, 2.9))
    for k, x in enumerate(series):
        alone = seir.fit_together(x[None], np.ones((1, len(x)), bool), np.array([1e5]), (2.5, 5.2, 2.9))
        assert np.allclose(alone[0][0], together[0][k], rtol=1e-4) and np.allclose([alone[1][0], alone[2][0]], [together[1][k], together[2][k]], rtol=1e-4)
        inside = (together[0][k] < [29.9] * 3).all() and (together[0][k] > [0.11, 0.51, 0.51]).all()
        for d in range(3 * inside):  # no neighbour fits better, unless the best was beyond the range of results
            for f in (0.98, 1.02):
                p = together[0][k] * np.where(np.arange(3) == d, f, 1.0)
                infected = max(1.0, x[x > 0][0])
                other = seir.curves_of(*p, 1e5, infected, len(x) - 1)[:, 4, 0]
                assert ((other - x) ** 2).mean() ** 0.5 >= together[1][k] - 1e-3


def test_simplex_search_of_many():
    def f(which, points):
        a = 1.0 + which[:, None]
        return (a - points[..., 0]) ** 2 + 10 * (points[..., 1] - points[..., 0] ** 2) ** 2

    found, least = epidemic.nelder_mead(f, (0.5, 0.5), 5, most=5000, tol=1e-9)
    assert np.allclose(found, [[a, a * a] for a in range(1, 6)], atol=1e-3) and (least < 1e-6).all()
    assert epidemic.nelder_mead(f, (0.5, 0.5), 0)[0].shape == (0, 2)


def test_quantiles_in_the_plan(spark):
    """Shapes below, at and above where the method changes, and values that have no quantile."""
    shapes = [0.05, 0.3, 1.0, 1.5, 4.0, 19.5, 20.0, 20.5, 101.0, 3e3, 1e5]
    rows = spark.createDataFrame([(a,) for a in [*shapes, 0.0, -1.0, None]], "a double").coalesce(1)
    for p in (0.0001, 0.025, 0.5, 0.975, 0.9999):
        got = [r.q for r in rows.select(quantiles.gamma_quantile(p, F.col("a"), 3.0).alias("q")).collect()]
        assert got[-3:] == [None] * 3 and np.allclose(got[:-3], gamma_quantile(p, shapes, 3.0), rtol=1e-9)
    assert abs(rows.where("a = 101").select(quantiles.gamma_quantile(0.025, F.col("a"), 0.01)).first()[0] - 0.8226615879) < 1e-9  # fixed value
    logs = [r.g for r in rows.where("a > 0").select(quantiles.log_gamma(F.col("a")).alias("g")).collect()]
    assert np.allclose(logs, [math.lgamma(a) for a in shapes], rtol=1e-13, atol=1e-13)
    plan = rows.select(quantiles.gamma_quantile(0.5, F.col("a")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_triggers_leave_no_match_out(spark):
    """Redaction and counts equal the patterns tried one by one, on texts put together from pieces."""
    import random
    import re

    pieces = ["Dr. Jane Doe", "12 Oak Hill Road", "12345-6789", "01/15/2024", "January 5, 2024", "(555) 123-4567", "fax: 555-123-4567", "a.b@c.org", "123-45-6789", "MRN: AB12345", "Medical Record No: 1234567", "Member ID: XK99201", "Acct No: 12345678"]
    pieces += ["License No: CA-77812", "cert # ABCDE", "1HGCM82633A004352", "ABCDEFGHJKLMNPRST", "Serial No: SN-00912", "https://x.org/p?q=1", "192.168.1.100", "a retina scan", "dna sample", "jane_photo.jpg", "Patient ID: P-001", "plain words", "[REDACTED_ID]", "ms"]
    rng, texts = random.Random(4), [None, ""]
    texts += pieces + [rng.choice([" ", "", "\n", ", "]).join(rng.choices(pieces, k=rng.randint(2, 5))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = privacy.strip_pii(rows, "t", "clean", "types").withColumn("counts", privacy.pii_counts(F.col("t"))).orderBy("k").collect()
    for r, text in zip(got, texts, strict=True):
        counts, types, now = {}, [], text
        for name, pattern, put in privacy.PATTERNS if text is not None else ():
            own = re.compile(pattern, re.IGNORECASE | re.ASCII)
            if n := len(own.findall(text)):
                counts[name] = n
            if own.search(now):
                types.append(name)
                now = own.sub(put, now)
        assert (r.clean, r.types, r.counts) == (now, sorted(types), counts)


def test_looking_back_over_one_list(spark):
    """Against a plain loop, over blocks of all sizes, with gaps and nulls; and no exchange into one partition but of blocks."""
    rng = np.random.default_rng(8)
    at = np.sort(rng.choice(400, 120, replace=False))
    rows = [(int(k), None if rng.random() < 0.2 else int(rng.integers(-5, 50)), f"s{k % 3}") for k in at]
    table = spark.createDataFrame(rows, "record_index long, v long, name string").repartition(5)
    for size in (1, 3, 50, 1000):
        out = ordered.with_running_sum(ordered.with_previous(table, ["v", "name"], size=size), ["v"], size=size).orderBy("record_index").collect()
        before, total = (None, None), 0
        for r, (k, v, name) in zip(out, rows, strict=True):
            total += v or 0
            assert (r.record_index, r.v, r.name, r["__v"], r["__name"], r.sum_v) == (k, v, name, *before, total)
            before = v, name
    assert ordered.with_previous(table.limit(0), ["v"]).count() == 0
    nulls = spark.createDataFrame([(None, 1), (None, 2), (5, 3)], "record_index long, v long")
    assert sorted((r.v, r["__v"]) for r in ordered.with_previous(nulls, ["v"]).collect()) == [(1, None), (2, None), (3, None)]
    plan = ordered.with_previous(table, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange SinglePartition") == 1 and "hashpartitioning(__b" in plan


def test_redaction_is_reported_as_it_is_written(spark, tmp_path):
    rows = [("1", "call 555-123-4567", 5), ("2", "a.b@c.org and x.y@z.org, 192.168.1.100", None), ("2", "a.b@c.org and x.y@z.org, 192.168.1.100", None), ("3", None, 0)]
    df = spark.createDataFrame(rows, "id string, text string, n int").repartition(2)
    got = privacy.redact_to(df, str(tmp_path / "a")).first()
    assert (got.records, got.pii_detected, got.pii_types_found, got.items_redacted) == (4, True, ["email", "ip_address", "phone"], 5)
    want = privacy.strip_records(df).select("id", "text", "n")
    assert sorted(map(repr, spark.read.parquet(str(tmp_path / "a")).collect())) == sorted(map(repr, want.collect()))
    again = privacy.redact_to(df.orderBy("id").coalesce(1), str(tmp_path / "b")).first()
    assert again.data_hash == got.data_hash  # in any order
    other = {privacy.redact_to(x, str(tmp_path / "c")).first().data_hash for x in (df.dropDuplicates(), df.fillna(""), df.fillna(1))}
    assert len(other | {got.data_hash}) == 4
    none = privacy.redact_to(df.limit(0), str(tmp_path / "d")).first()
    assert (none.records, none.pii_detected, none.pii_types_found, none.items_redacted) == (0, False, [], 0) and spark.read.parquet(str(tmp_path / "d")).count() == 0


def test_importances_stand_in_for_shapley_values(spark):
    series = spark.createDataFrame([("a", "p"), ("a", "p"), ("b", "p")], "region string, pathogen string")
    got = explain.importance_drivers(series, {"lag_2": 0.3, "lag_1": 0.3, "month": 0.4}, 2).orderBy("region", "rank").collect()
    assert [(r.region, r.feature, r.rank, r.label) for r in got] == [(s, f, k, t) for s in "ab" for f, k, t in (("month", 1, "calendar month"), ("lag_1", 2, "new cases 1 day earlier"))]
    assert explain.importance_drivers(series, {}).count() == 0


def test_overlay_meets_its_own_curve(spark):
    daily = frame(spark, [1, 2, 3]).unionByName(frame(spark, [4, 5, 6], "s"))
    one = spark.createDataFrame([("x", 0, 0.5), ("x", 1, 1.5), ("x", 70, 9.0)], "scenario_id string, day int, incidence double")
    assert sorted((r.region, r.new_cases, r.modelled) for r in report.model_overlay(daily, one).collect()) == [("r", 1, 0.5), ("r", 2, 1.5), ("s", 4, 0.5), ("s", 5, 1.5)]
    keyed = spark.createDataFrame([("r", "p", 0, 0.5), ("s", "p", 0, 7.0)], "region string, pathogen string, day int, incidence double")
    assert sorted((r.region, r.modelled) for r in report.model_overlay(daily, keyed).collect()) == [("r", 0.5), ("s", 7.0)]
    with pytest.raises(Exception, match="several scenarios"):
        report.model_overlay(daily, one.unionByName(one.withColumn("scenario_id", F.lit("y")))).collect()


def test_rounding_half_way_as_sql(spark):
    import duckdb
    from outbreak_spark.functions.expressions import rounded

    values = [k / 2_000_000 for k in range(1, 12001, 2)] + [-0.0009855, 403.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(rounded(F.col("v"), 6)).collect()]
    want = [r[0] for r in duckdb.sql(f"SELECT round(v, 6) FROM (SELECT unnest({values!r}::DOUBLE[]) AS v)").fetchall()]
    assert got == want and any(g != r[0] for g, r in zip(got, spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(F.round("v", 6)).collect(), strict=True))


def test_upper_quantiles_of_large_shapes(spark):
    """Against Poisson sums over all terms that count: the power series of the plans' SQL is cut before them there."""
    import math

    for a in (700.0, 4031.0, 25_000.0):
        x = spark.range(1).select(quantiles.gamma_quantile(0.975, F.lit(a))).first()[0]
        share = math.fsum(math.exp((a + n) * math.log(x) - x - math.lgamma(a + n + 1)) for n in range(int(20 * math.sqrt(a)) + 200))
        assert abs(share - 0.975) < 1e-7 and x < a + 3 * math.sqrt(a)
