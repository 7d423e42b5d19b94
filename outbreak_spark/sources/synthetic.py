"""Seeded epidemics: one random stream per series, each in a task of its own."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outbreak_spark.model import KEYS
from outbreak_spark.operators.seir import curves_of

ROWS = "region string, pathogen string, date date, record_index long, new_cases long, new_deaths long, population long"
SCENARIO = "region string, pathogen string, r0 double, latent_days double, infectious_days double, cfr double, population long, duration_days int, initial_infected int, noise_level double, seed long, start_date date"


def _finish(rows: DataFrame, source: str) -> DataFrame:
    from outbreak_spark.model import series

    w = series().rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cumulative_cases", F.sum("new_cases").over(w)).withColumn("cumulative_deaths", F.sum("new_deaths").over(w)).withColumn("source", F.lit(source)).withColumn("metadata", F.create_map().cast("map<string,string>"))


def _draw(rng: np.random.Generator, expected: float, noise: float | None) -> int:
    """noise None: Poisson; 0: the rounded expectation; else Poisson about a normally disturbed expectation."""
    if noise is None:
        return int(rng.poisson(expected)) if expected > 0 else 0
    if noise > 0 and expected > 0:
        return int(rng.poisson(max(0.0, expected * (1 + noise * rng.standard_normal()))))
    return int(round(expected))


def generate_epidemic(scenarios: DataFrame) -> DataFrame:
    """duration_days + 1 daily records per scenario (columns of SCENARIO): noise, then weekends report 30 % less and
    Mondays 40 % more, then deaths. A start_date is required: weekends depend on it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf.itertuples(index=False):
                expected = curves_of(p.r0, p.latent_days, p.infectious_days, p.population, p.initial_infected, p.duration_days)[:, 4, 0]
                rng, out = np.random.default_rng(p.seed), []
                for day, x in enumerate(expected):
                    date = p.start_date + datetime.timedelta(days=day)
                    n = _draw(rng, float(x), p.noise_level)
                    if date.weekday() >= 5:
                        n -= int(0.3 * n)
                    elif date.weekday() == 0:
                        n = int(1.4 * n)
                    deaths = int(rng.binomial(n, p.cfr)) if n > 0 and p.cfr > 0 else 0
                    out.append((p.region, p.pathogen, date, day, n, deaths, p.population))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])

    return _finish(scenarios.mapInPandas(run, ROWS), "synthetic")


def generate_multi_wave(scenarios: DataFrame, waves: int = 2, gap_days: int = 60, decay: float = 0.7) -> DataFrame:
    """Waves that start gap_days apart, each with the last one's reproduction number times decay, added day by day;
    Poisson counts, no weekend effect."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf.itertuples(index=False):
                total = np.zeros(p.duration_days + 1)
                for k in range(waves):
                    left = p.duration_days - k * gap_days
                    if left <= 0:
                        break
                    total[k * gap_days :] += curves_of(p.r0 * decay**k, p.latent_days, p.infectious_days, p.population, p.initial_infected, left)[:, 4, 0]
                rng, out = np.random.default_rng(p.seed), []
                for day, x in enumerate(total):
                    n = _draw(rng, float(x), None)
                    deaths = int(rng.binomial(n, p.cfr)) if n > 0 and p.cfr > 0 else 0
                    out.append((p.region, p.pathogen, p.start_date + datetime.timedelta(days=day), day, n, deaths, p.population))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])

    return _finish(scenarios.mapInPandas(run, ROWS), "synthetic_multi_wave")


def scenarios(spark, rows: list[dict]) -> DataFrame:
    """Scenario rows by pathogen name; other fields default to its profile."""
    from outbreak_spark.model import ALIASES, PROFILES

    out = []
    for r in rows:
        name = r.get("pathogen", "covid-19").lower()
        name = ALIASES.get(name, name)
        if name not in PROFILES:
            raise ValueError(f"unknown pathogen {name!r}; known: {sorted(PROFILES)}")
        r0, latent, infectious, cfr, people = PROFILES[name]
        out.append((r.get("region", "synthetic_region"), name, float(r.get("r0", r0)), float(r.get("latent_days", latent)), float(r.get("infectious_days", infectious)), float(r.get("cfr", cfr)), int(r.get("population", people)), int(r.get("duration_days", 180)), int(r.get("initial_infected", 10)), float(r.get("noise_level", 0.1)), int(r.get("seed", 42)), r["start_date"]))
    return spark.createDataFrame(out, SCENARIO)


__all__ = ["KEYS", "generate_epidemic", "generate_multi_wave", "scenarios"]
