"""Alert levels, situation reports and a static dashboard."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outbreak_spark.functions.expressions import alert_level, quality_gate
from outbreak_spark.model import KEYS, ORDER


def situation_report(metrics: DataFrame, rt: DataFrame, score: DataFrame, rapid_days: float | None = None) -> DataFrame:
    """A row per series: alert level, gate, headline figures and a summary text. metrics: epi_metrics(); rt: current()
    with rt_mean and phase; score: report() by series."""
    x = metrics.join(rt, KEYS, "left").join(score.select(*KEYS, "quality_score"), KEYS, "left")
    level = alert_level(F.col("rt_mean"), F.col("doubling_time"), rapid_days)
    text = F.concat_ws(" ", F.concat(F.initcap("pathogen"), F.lit(" in "), F.col("region"), F.lit(":")), F.concat(F.format_number("cases", 0), F.lit(" cases,")), F.concat(F.format_number("deaths", 0), F.lit(" deaths,")), F.concat(F.lit("Rt "), F.coalesce(F.format_number("rt_mean", 2), F.lit("unknown")), F.lit(" ("), F.coalesce("phase", F.lit("unknown")), F.lit(").")))
    return x.select(*KEYS, level.alias("alert_level"), quality_gate(F.col("quality_score")).alias("gate"), "quality_score", "cases", "deaths", "cfr", "incidence", "attack_rate", "growth_rate", "doubling_time", "rt_mean", "phase", "peak_date", "peak_cases", text.alias("summary"))


def envelope(df: DataFrame, digits: int = 4) -> DataFrame:
    """Each row as JSON, doubles rounded; nulls stay null."""
    cols = [F.bround(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def model_overlay(daily: DataFrame, curve: DataFrame, days: int = 60) -> DataFrame:
    """Observed and modelled cases by day of the model's first days. The curve is of one scenario, or has the series' keys,
    by which each series then meets its own; several scenarios without keys are an error."""
    first = curve.where(F.col("day") < days).select(*(c for c in KEYS if c in curve.columns), F.col("day").cast("long").alias(ORDER), F.col("incidence").alias("modelled"))
    own = [c for c in KEYS if c in first.columns]
    if not own:
        first = first.groupBy(ORDER).agg(F.count("*").alias("n"), F.max("modelled").alias("modelled"))
        first = first.withColumn("modelled", F.when(F.col("n") == 1, F.col("modelled")).otherwise(F.raise_error(F.lit("several scenarios have this day: the curve needs region and pathogen")).cast("double")))
    return daily.join(first, [*own, ORDER]).select(*KEYS, "date", "new_cases", "modelled")


def forecast_panel(daily: DataFrame, forecasts: DataFrame, history: int = 60) -> DataFrame:
    """The last records of each series and, after them, the forecast with its band."""
    from pyspark.sql import Window

    w = Window.partitionBy(*KEYS).orderBy(F.desc(ORDER))
    past = daily.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= history)
    none = F.lit(None).cast("double")
    past = past.select(*KEYS, F.col("date").cast("date").alias("date"), F.lit("history").alias("kind"), F.col("new_cases").cast("double").alias("value"), none.alias("lower"), none.alias("upper"))
    return past.unionByName(forecasts.select(*KEYS, "date", F.lit("forecast").alias("kind"), F.col("predicted").alias("value"), "lower", "upper"))


def _line(points: list[tuple[float, float]], width: int = 640, height: int = 160) -> str:
    if not points:
        return ""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    top, span = max(max(ys), 1e-9), max(max(xs) - min(xs), 1e-9)
    path = " ".join(f"{(x - min(xs)) / span * width:.1f},{height - y / top * height:.1f}" for x, y in points)
    return f'<svg viewBox="0 0 {width} {height}"><polyline fill="none" stroke="#1f77b4" points="{path}"/></svg>'


def rt_panel(rt: DataFrame, days: int = 30) -> DataFrame:
    """The last records of each series with a known reproduction number."""
    from pyspark.sql import Window

    w = Window.partitionBy(*KEYS).orderBy(F.desc(ORDER))
    return rt.where("rt_mean is not null").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= days).drop("__r")


def changepoint_overlay(daily: DataFrame, changes: DataFrame) -> DataFrame:
    """Date, cases and probability at each changepoint that has a record; 0.5 where its probability is unknown."""
    flagged = changes.where("is_changepoint").select(*KEYS, ORDER, F.coalesce("changepoint_prob", F.lit(0.5)).alias("changepoint_prob"))
    return daily.select(*KEYS, ORDER, "date", "new_cases").join(flagged, [*KEYS, ORDER])


def dashboard(daily: DataFrame, report: DataFrame, region: str, pathogen: str, rt: DataFrame | None = None, forecasts: DataFrame | None = None, drivers: DataFrame | None = None, changes: DataFrame | None = None, curve: DataFrame | None = None, path: str | None = None, points: int = 3660) -> str:
    """A static page for one series, written to `path` if given; empty text without records. Panels: cases with the
    changepoints' days, reproduction number, model against cases, forecast, drivers from the least on. Lines have at most
    `points` points: longer series are shown by means of as many records each as that takes."""
    one = (F.col("region") == region) & (F.col("pathogen") == pathogen)

    def line(df: DataFrame | None, y: str, x: str = ORDER) -> str:
        if df is None:
            return ""
        own = df.where(one) if "region" in df.columns else df
        most = own.agg(F.max(x)).first()[0] or 0
        width = int(most) // points + 1
        rows = own.groupBy(F.floor(F.col(x) / width).alias("x")).agg(F.avg(y).alias("y")).where("y is not null").orderBy("x").collect()  # at most `points`
        return _line([(r.x * width, r.y) for r in rows])

    cases = line(daily, "new_cases")
    if not cases:
        return ""
    card = report.where(one).limit(1).collect()
    cards = "".join(f'<div class="{html.escape(str(v)).lower()}"><b>{html.escape(k)}</b> {html.escape(str(v))}</div>' for k, v in (card[0].asDict(True).items() if card else ()))
    panels = [("Daily cases", cases)]
    if changes is not None:
        days = [f"{r.date} ({r.changepoint_prob:.2f})" for r in changepoint_overlay(daily.where(one), changes.where(one)).orderBy(F.desc("changepoint_prob"), ORDER).limit(20).collect()]
        panels.append(("Likeliest changes", html.escape(", ".join(days) or "none")))
    if rt is not None:
        panels.append(("Reproduction number", line(rt_panel(rt.where(one)), "rt_mean")))
    if curve is not None:
        panels.append(("Model", line(model_overlay(daily.where(one), curve).withColumn(ORDER, F.datediff("date", F.lit("1970-01-01"))), "modelled")))
    if forecasts is not None:
        panels.append(("Forecast", line(forecasts.where(one).groupBy(*KEYS, "step").agg(F.avg("predicted").alias("predicted")), "predicted", "step")))
    if drivers is not None:
        top = drivers.where(one).orderBy(F.desc("rank")).limit(20).collect()
        panels.append(("Drivers", "".join(f"<div>{html.escape(r.label)}: {r.importance:.2f}</div>" for r in top)))
    title = f"{html.escape(pathogen)} in {html.escape(region)}"
    page = f"<!doctype html><title>{title}</title><h1>{title}</h1>{cards}" + "".join(f"<h2>{name}</h2>{body}" for name, body in panels if body)
    if path:
        with open(path, "w", encoding="utf-8") as out:
            out.write(page)
    return page
