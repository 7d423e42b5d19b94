"""Queries of the surveillance operators over the driver's tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outbreak_spark import model
from outbreak_spark.functions import privacy
from outbreak_spark.functions.expressions import alert_level, seir_rates, wilson
from outbreak_spark.model import KEYS, ORDER
from outbreak_spark.operators import changepoint, explain, features, forecast, metrics, pooled, quality, report, rt, seir
from outbreak_spark.shared import new_folder
from outbreak_spark.sources import records, synthetic, tables

AS_OF = datetime.date(2024, 1, 25)
WEIGHTS = rt.weights_of("covid-19")


def day(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns or ("date",):
        df = df.withColumn(c, F.col(c).cast("string"))
    return df


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def messy(spark: SparkSession, path: str) -> DataFrame:
    """Event records with planted faults, by record_index."""
    i, x = F.col(ORDER), tables.from_events(spark, path)
    date = F.when(i % 17 == 7, "2024-13-01").when(i % 19 == 8, "").when(i % 23 == 9, F.lit(None)).when(i % 29 == 10, "20240115").otherwise(F.col("date").cast("string"))
    cases = F.when(i % 11 == 3, F.lit(-5)).when(i % 13 == 4, F.lit(None)).when(i % 7 == 6, F.col("new_cases") * 10).otherwise(F.col("new_cases"))
    return x.select(*KEYS, ORDER, date.alias("date"), cases.cast("long").alias("new_cases"), F.when(i % 5 == 4, F.col("cumulative_cases") - 1000).otherwise(F.col("cumulative_cases")).alias("cumulative_cases"), F.when(i % 9 == 2, F.col("new_cases") + 1).otherwise(F.col("new_deaths")).alias("new_deaths"), "cumulative_deaths", F.when(i % 12 == 1, F.lit(None)).when(i % 12 == 2, F.lit(0)).otherwise(F.col("population")).cast("long").alias("population"))


def messy_issues(spark: SparkSession, path: str) -> DataFrame:
    return quality.issues(messy(spark, path), as_of=AS_OF)


def _columns(struct: str, *more: str) -> list:
    return [*KEYS, *more, F.round(f"{struct}.value", 9).alias("value"), F.round(f"{struct}.lower_ci", 9).alias("lower_ci"), F.round(f"{struct}.upper_ci", 9).alias("upper_ci")]


def surveillance_daily(spark, path):
    return day(tables.from_events(spark, path).select(*KEYS, "date", "new_cases", "new_deaths", "population"))


def cumulative_counts(spark, path):
    return day(tables.from_events(spark, path).select(*KEYS, "date", ORDER, "cumulative_cases", "cumulative_deaths"))


def calendar_fill(spark, path):
    return day(tables.from_shipments(spark, path).select("region", "date", ORDER, "new_cases", "new_deaths", "population", "cumulative_cases"))


def rt_infectiousness(spark, path):
    return rounded(day(rt.infectiousness(tables.from_events(spark, path)).select(*KEYS, "date", "new_cases", "lam")))


def rt_posterior(spark, path):
    return rounded(day(rt.posterior(tables.from_events(spark, path)).select(*KEYS, "date", "shape", "scale", "rt_mean")), 8)


def rt_credible(spark, path):
    return rounded(day(rt.estimate_rt(tables.from_events(spark, path)).select(*KEYS, "date", "rt_mean", "rt_lower", "rt_upper", "phase", "is_prior_dominated")))


def rt_current(spark, path):
    return rounded(day(rt.current(rt.posterior(tables.from_events(spark, path)), "date", "rt_mean")))


def rt_by_pathogen(spark, path):
    """Series of pathogens that have serial intervals of their own, by name and other name, and of unknown ones."""
    name = F.when(F.col("pathogen") == "click", "Flu").when(F.col("pathogen") == "purchase", "measles").otherwise(F.col("pathogen"))
    return rounded(day(rt.posterior(tables.from_events(spark, path).withColumn("pathogen", name)).select(*KEYS, "date", "lam", "rt_mean")))


def dataset_contents(spark, path):
    return metrics.contents(tables.from_events(spark, path)).select(*(F.array_join(c, ",").alias(c) for c in ("regions", "pathogens")))


def first_issues(spark, path):
    return quality.first_issues(messy_issues(spark, path)).select("rank", *KEYS, ORDER, "check_seq", "severity", "field")


def dataset_issues(spark, path):
    """Series of which more than 2 in 25 needed values are missing; two regions lack a third of their populations."""
    x = messy(spark, path)
    x = x.withColumn("population", F.when(~(F.col("region").isin("r0", "r1") & (F.col(ORDER) % 3 == 0)), F.col("population")))
    scored = quality.report(x, quality.issues(x, as_of=AS_OF), by=tuple(KEYS))
    return quality.dataset_issues(scored, completeness=0.92, by=tuple(KEYS)).select(*KEYS, ORDER, "severity", "field")


def alert_levels(spark, path):
    now = rt.current(rt.posterior(tables.from_events(spark, path)), "rt_mean")
    return now.select(*KEYS, alert_level(F.col("rt_mean")).alias("alert_level"))


def cfr_wilson(spark, path):
    return metrics.case_fatality(metrics.totals(tables.from_events(spark, path))).select(_columns("cfr", "cases", "deaths"))


def attack_rate(spark, path):
    return metrics.attack_rate(metrics.totals(tables.from_events(spark, path))).select(_columns("attack_rate", "cases", "population"))


def wilson_edges(spark, path):
    """Counts where the interval is degenerate: suppliers with few trials, none, or more successes than trials."""
    lines = spark.read.parquet(f"{path}/lineitem.parquet").select("l_suppkey", (F.col("l_returnflag") == "R").alias("back"), "l_quantity")
    rows = spark.read.parquet(f"{path}/supplier.parquet").select("s_suppkey").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    rows = rows.groupBy("s_suppkey").agg(F.count_if(F.col("back") & (F.col("l_quantity") > 47)).alias("deaths"), F.count_if(F.col("l_quantity") > 49).alias("cases"))
    w = wilson(F.col("deaths"), F.col("cases"))
    return rows.select("s_suppkey", "deaths", "cases", *(F.round(w[c], 9).alias(c) for c in ("value", "lower_ci", "upper_ci")))


def incidence_rate(spark, path):
    return metrics.incidence_rate(metrics.totals(tables.from_events(spark, path))).select(*KEYS, F.round("incidence.value", 6).alias("value"))


def incidence_interval(spark, path):
    return metrics.incidence_rate(metrics.totals(tables.from_events(spark, path))).select(_columns("incidence"))


def growth_rate(spark, path):
    return rounded(metrics.growth(tables.from_events(spark, path)).select(*KEYS, "n", "growth_rate", "se", "growth_lower", "growth_upper"), 7)


def doubling_time(spark, path):
    return rounded(metrics.growth(tables.from_events(spark, path)).select(*KEYS, "doubling_time"), 4)


def epi_metrics(spark, path):
    return rounded(day(metrics.epi_metrics(tables.from_events(spark, path)).select(*KEYS, "cases", "cfr.value", "incidence.lower_ci", "growth_rate", "doubling_time", "first_date"), "first_date"))


def quality_issues(spark, path):
    return messy_issues(spark, path).select(*KEYS, ORDER, "check_seq", "severity", "field")


def _score(x: DataFrame) -> DataFrame:
    return rounded(x.select("total_records", "valid_records", "errors", "warnings", "completeness", "quality_score", "is_acceptable", "gate", *(c for c in KEYS if c in x.columns)))


def list_issues(spark, path):
    """Checks that look back, over one list of all records in the order of date and series."""
    place = F.col(ORDER) * 1000 + F.substring("region", 2, 1).cast("long") * 100 + F.ascii("pathogen")
    x = messy(spark, path).withColumn(ORDER, place)
    found = quality.issues(x, as_of=AS_OF, partitioned=False).where("check_seq >= 11")
    return found.select(*KEYS, ORDER, "check_seq", "severity", "field")


def quality_score(spark, path):
    return _score(quality.report(messy(spark, path), messy_issues(spark, path), by=tuple(KEYS)))


def quality_overall(spark, path):
    return _score(quality.report(messy(spark, path), messy_issues(spark, path)))


def valid_records(spark, path):
    return quality.valid_records(messy(spark, path), messy_issues(spark, path)).select(*KEYS, ORDER, "date", "new_cases", "population")


def spikes(spark, path):
    return messy_issues(spark, path).where("check = 'spike'").select(*KEYS, ORDER, F.col("value").cast("double").alias("fold"))


def monotonicity(spark, path):
    return messy_issues(spark, path).where("check = 'falling_total'").select(*KEYS, ORDER, "field", F.col("value").cast("long").alias("value"))


def completeness(spark, path):
    x = quality.report(messy(spark, path), messy_issues(spark, path), by=tuple(KEYS))
    return rounded(x.select(*KEYS, F.col("missing").cast("long").alias("missing"), "completeness"))


def pii_texts(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    return docs.unionByName(spark.read.parquet(f"{path}/conversations.parquet").select(F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("id"), "text"))


def pii_detect_counts(spark, path):
    return pii_texts(spark, path).select("id", F.explode(privacy.pii_counts(F.col("text"))).alias("type", "n")).select("id", "type", F.col("n").cast("long").alias("n"))


def pii_redact_docs(spark, path):
    out = privacy.strip_pii(pii_texts(spark, path), "text", "clean", "types")
    return out.select("id", "clean", F.array_join("types", ",").alias("types"))


def pii_types(spark, path):
    return pii_detect_counts(spark, path).groupBy("type").agg(F.sum("n").alias("matches"), F.count("*").alias("texts"))


def pii_audit(spark, path):
    out = privacy.audit(pii_texts(spark, path).select("text"))
    return out.select("pii_detected", F.array_join("pii_types_found", ",").alias("pii_types_found"), "matches")


def redaction_report(spark, path):
    """What redacting all texts found, observed while the redacted table is written."""
    out = privacy.redact_to(pii_texts(spark, path), new_folder(spark, "redacted"))
    return out.withColumn("pii_types_found", F.array_join("pii_types_found", ","))


def dataset_hash(spark, path):
    return privacy.dataset_hash(tables.from_events(spark, path), [*KEYS, "date", "new_cases", "new_deaths"], [*KEYS, ORDER])


def lag_features(spark, path):
    return rounded(day(features.lag_features(tables.from_events(spark, path))))


def rolling_curve(spark, path):
    return rounded(day(metrics.rolling_curve(tables.from_events(spark, path))))


def top_days(spark, path):
    return day(metrics.top_days(tables.from_events(spark, path)))


def dataset_summary(spark, path):
    return day(metrics.totals(tables.from_events(spark, path)), "first_date", "last_date", "peak_date")


def peak_day(spark, path):
    return day(metrics.totals(tables.from_shipments(spark, path)).select("region", "records", "cases", "peak_date", "peak_cases"), "peak_date")


def epiweek_dates(spark, path):
    """The weeks in which orders were placed, 53rd ones included."""
    at = F.col("o_orderdate")
    weeks = spark.read.parquet(f"{path}/orders.parquet").select((F.year(at) * 100 + F.floor((F.dayofyear(at) - 1) / 7) + 1).cast("long").alias("epiweek")).distinct()
    return day(weeks.select("epiweek", records.epiweek_to_date(F.col("epiweek")).alias("date"), records.epiweek_to_date(F.col("epiweek"), legacy=True).alias("legacy_date")), "date", "legacy_date")


def fluview_records(spark, path):
    """Records of payloads, one per region, that are made of the events as the service would send them: JSON texts, with
    unknown counts."""
    events = spark.read.parquet(f"{path}/events.parquet").select((F.col("user_id") % 5).alias("k"), (F.year("ts") * 100 + F.floor((F.dayofyear("ts") - 1) / 7) + 1).cast("int").alias("epiweek"), "event_type")
    name = F.when(F.col("k") == 0, "nat").otherwise(F.concat(F.lit("hhs"), F.col("k")))
    weeks = events.groupBy(name.alias("region"), "epiweek").agg(F.count_if(F.col("event_type") == "click").alias("n"), F.count("*").alias("num_patients"))
    one = F.struct("epiweek", "region", F.when(F.col("epiweek") % 2 == 1, F.col("n")).alias("num_ili"), "num_patients")
    bodies = weeks.groupBy("region").agg(F.array_sort(F.collect_list(one)).alias("epidata")).select(F.to_json(F.struct(F.lit(1).alias("result"), F.lit("success").alias("message"), "epidata")).alias("b"))
    payload = bodies.select(F.from_json("b", records.PAYLOAD).alias("p")).select("p.*")
    return records.from_payload(payload).select(ORDER, "date", "region", "pathogen", "new_cases", "population", "source")


def population_join(spark, path):
    asked = spark.read.parquet(f"{path}/nation.parquet").select("n_name", F.concat(F.lit("HHS"), (F.col("n_nationkey") % 12).cast("string")).alias("asked"))
    return asked.join(F.broadcast(model.population_table(spark)), F.lower("asked") == F.col("region"), "left").select("n_name", "asked", "population")  # 13 fixed rows


def _asked(spark, path):
    """Nations, and the name by which each asks for a pathogen: names in any case, other names, unknown ones."""
    names = F.array(*map(F.lit, ("influenza", "COVID", "Measles", "Flu", "covid-19", "ebola")))
    return spark.read.parquet(f"{path}/nation.parquet").select("n_nationkey", "n_name", names[F.col("n_nationkey") % 6].alias("asked"))


def pathogen_profiles(spark, path):
    t = F.broadcast(model.profile_table(spark))  # 5 fixed rows
    r = seir_rates(F.col("r0"), F.col("latent_days"), F.col("infectious_days"))
    x = _asked(spark, path).join(t, F.lower("asked") == F.col("name"), "left")
    return rounded(x.select("n_name", "asked", "pathogen", "r0", "cfr", "population", *(r[c].alias(c) for c in ("beta", "sigma", "gamma"))), 9)


def serial_interval_pmf(spark, path):
    """Weights by day of the pathogen that each nation asks for; unknown ones have the default pathogen's."""
    t = F.broadcast(model.serial_interval_table(spark))  # 63 fixed rows
    name = F.lower("asked")
    for other, own in model.ALIASES.items():
        name = F.when(name == other, own).otherwise(name)
    known = F.when(name.isin(list(model.SERIAL_INTERVALS)), name).otherwise(model.DEFAULT_PATHOGEN)
    return rounded(_asked(spark, path).select("n_name", known.alias("pathogen")).join(t, "pathogen").select("n_name", "pathogen", "day", "weight"), 9)


def changepoint_prob(spark, path):
    return rounded(changepoint.changepoints(tables.from_events(spark, path)).select(*KEYS, ORDER, "changepoint_prob", "is_changepoint"))


def changepoint_summary(spark, path):
    x = changepoint.summary(changepoint.changepoints(tables.from_events(spark, path)))
    return rounded(x.select(*KEYS, "max_prob", "changepoints", F.array_join("indices", ",").alias("indices")))


def changepoint_runlength(spark, path):
    return rounded(changepoint.changepoints(tables.from_shipments(spark, path)).select("region", ORDER, "map_run_length", "expected_run_length", "run_dropped"))


def _scenarios(spark, path):
    """A scenario per nation: as many people as its customers stand for, and periods by its key; one without infected."""
    nations = spark.read.parquet(f"{path}/nation.parquet").select("n_nationkey", "n_name")
    people = spark.read.parquet(f"{path}/customer.parquet").groupBy("c_nationkey").agg((F.count("*") * 10_000).alias("people"))
    k = F.col("n_nationkey")
    cols = [(1.2 + k * 0.3).alias("r0"), (2.0 + k % 5).alias("latent_days"), (3.0 + k % 4).alias("infectious_days"), F.coalesce("people", F.lit(10_000)).cast("double").alias("population"), F.when(k == 3, 0.0).otherwise(10.0).alias("initial_infected")]
    return nations.join(people, k == F.col("c_nationkey"), "left").select(F.col("n_name").alias("scenario_id"), *cols, F.lit(120).alias("t_max"))


def seir_curve(spark, path):
    return rounded(seir.seir_curves(_scenarios(spark, path)), 3)


def seir_summary(spark, path):
    return rounded(seir.seir_summary(seir.seir_curves(_scenarios(spark, path))), 3)


def seir_fit(spark, path):
    return rounded(seir.fit_seir(tables.from_events(spark, path)), 4)


def _epidemics(spark, path):
    """A seeded epidemic per nation, of its scenario."""
    x = _scenarios(spark, path)
    fixed = {"cfr": F.lit(0.01), "duration_days": F.lit(90), "noise_level": F.lit(0.1), "start_date": F.lit(datetime.date(2024, 1, 1))}
    x = x.select(F.col("scenario_id").alias("region"), F.lit("covid-19").alias("pathogen"), "r0", "latent_days", "infectious_days", F.col("population").cast("long").alias("population"), F.col("initial_infected").cast("int").alias("initial_infected"), F.crc32(F.col("scenario_id").cast("binary")).alias("seed"), *(c.alias(n) for n, c in fixed.items()))
    return x.select([c.split()[0] for c in synthetic.SCENARIO.split(", ")])


def synthetic_epidemic(spark, path):
    return day(synthetic.generate_epidemic(_epidemics(spark, path)).drop("metadata"))


def multi_wave(spark, path):
    return day(synthetic.generate_multi_wave(_epidemics(spark, path)).drop("metadata"))


def forecasts(spark, path):
    return rounded(day(forecast.forecast(tables.from_shipments(spark, path)).drop("importance")), 4)


def ensemble_forecast(spark, path):
    return rounded(day(forecast.ensemble(forecast.forecast(tables.from_shipments(spark, path)))), 4)


def pooled_forecast(spark, path):
    """By one model of all series: 40 trees of depth 5, as each level of a tree is a job; its features that matter most."""
    out, _ = pooled.forecast(tables.from_shipments(spark, path), trees=40, depth=5, rate=0.2)
    best = F.slice(F.transform(F.array_sort(F.transform(F.map_entries("importance"), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("f")))), lambda e: e["f"]), 1, 3)
    return rounded(day(out.withColumn("importance", F.array_join(best, ",")).withColumnRenamed("importance", "top_features")), 4)


def ensemble_weights(spark, path):
    t = metrics.totals(tables.from_events(spark, path))
    rows = t.select(*KEYS, F.explode(F.array(F.struct(F.lit("m1").alias("model"), (F.col("cases") % 7).cast("double").alias("rmse")), F.struct(F.lit("m2").alias("model"), (F.col("cases") % 5 + 0.5).cast("double").alias("rmse")), F.struct(F.lit("m3").alias("model"), F.lit(None).cast("double").alias("rmse")))).alias("m")).select(*KEYS, "m.model", "m.rmse")
    return rounded(forecast.ensemble_weights(rows), 9)


def shap_drivers(spark, path):
    phi = explain.shapley_values(features.lag_features(tables.from_events(spark, path)))
    return rounded(explain.drivers(phi), 4)


def _phi(spark, path):
    x = tables.from_events(spark, path).select(*KEYS, F.col(ORDER).cast("int").alias("row"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"), "new_cases")
    return x.select(*KEYS, "row", F.concat(F.lit("lag_"), F.col("k")).alias("feature"), ((F.col("new_cases") * F.col("k")) % 17 - 8).cast("double").alias("phi"))


def shap_time_buckets(spark, path):
    return rounded(explain.time_buckets(_phi(spark, path)))


def top_drivers(spark, path):
    return rounded(explain.drivers(_phi(spark, path), 2))


def driver_trends(spark, path):
    return explain.trends(explain.time_buckets(_phi(spark, path)))


def situation_reports(spark, path):
    x = tables.from_events(spark, path)
    now = rt.current(rt.estimate_rt(x), "rt_mean", "phase")
    score = quality.report(x, quality.issues(x, as_of=AS_OF), by=tuple(KEYS))
    return report.envelope(report.situation_report(metrics.epi_metrics(x), now, score))


#: Rows only: no SQL for these.
ITERATIVE = [changepoint_runlength, seir_curve, seir_summary, seir_fit, synthetic_epidemic, multi_wave, forecasts, ensemble_forecast, pooled_forecast, shap_drivers, situation_reports]
RELATIONAL = [
    rt_credible, epi_metrics, incidence_interval, surveillance_daily, cumulative_counts, calendar_fill, rt_infectiousness, rt_posterior, rt_current, alert_levels, cfr_wilson, attack_rate, wilson_edges, incidence_rate, growth_rate, doubling_time, quality_issues, list_issues, quality_score, quality_overall, valid_records, spikes, monotonicity, completeness, pii_detect_counts,
    pii_redact_docs, pii_types, pii_audit, redaction_report, dataset_hash, lag_features, rolling_curve, top_days, dataset_summary, peak_day, epiweek_dates, fluview_records, population_join, pathogen_profiles, serial_interval_pmf, changepoint_prob, changepoint_summary, rt_by_pathogen, dataset_contents, first_issues, dataset_issues, ensemble_weights, shap_time_buckets, top_drivers, driver_trends,
]

QUERIES = {f.__name__: f for f in RELATIONAL + ITERATIVE}
