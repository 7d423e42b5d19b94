"""SEIR curves of scenarios, as a table function and in batches, and fits to observed series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outbreak_spark.kernels import epidemic
from outbreak_spark.model import KEYS, ORDER

CURVE = "scenario_id string, day int, s double, e double, i double, r double, incidence double, error string"


def curves_of(r0, latent, infectious, population, infected, days: int, tol: float = 1e-8) -> np.ndarray:
    r0, latent, infectious, population, infected = (np.atleast_1d(np.asarray(v, float)) for v in (r0, latent, infectious, population, infected))
    if (latent <= 0).any() or (infectious <= 0).any():
        raise ValueError("periods must be positive")
    start = np.stack([population - infected, np.zeros_like(infected), infected, np.zeros_like(infected)])
    curve = epidemic.seir(r0 / infectious, 1 / latent, 1 / infectious, population, start, days, tol)
    return np.concatenate([curve, epidemic.incidence(curve)[:, None]], 1)


def seir_curves(scenarios: DataFrame) -> DataFrame:
    """A row per day 0 .. t_max of each scenario: scenario_id, r0, latent_days, infectious_days, population,
    initial_infected, t_max. Scenarios of a batch with the same t_max are integrated together. One that can't be integrated
    is a row without a day, with the reason in error."""
    columns = ["scenario_id", "r0", "latent_days", "infectious_days", "population", "initial_infected", "t_max"]

    def failed(p: pd.DataFrame, why: str) -> pd.DataFrame:
        return pd.DataFrame({"scenario_id": p.scenario_id, "day": pd.array([None] * len(p), "Int32"), **{c: np.nan for c in ("s", "e", "i", "r", "incidence")}, "error": why})

    def curves(p: pd.DataFrame, t_max: int) -> pd.DataFrame:
        try:
            c = curves_of(p.r0, p.latent_days, p.infectious_days, p.population, p.initial_infected, t_max)
        except ArithmeticError as e:
            return pd.concat([curves(p.iloc[k : k + 1], t_max) for k in range(len(p))]) if len(p) > 1 else failed(p, str(e))
        n = c.shape[0]
        flat = {name: c[:, k].T.ravel() for k, name in enumerate(("s", "e", "i", "r", "incidence"))}
        return pd.DataFrame({"scenario_id": np.repeat(p.scenario_id.to_numpy(), n), "day": pd.array(np.tile(np.arange(n, dtype=np.int32), len(p)), "Int32"), **flat, "error": None})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            number = pdf[columns[1:]].astype(float)
            good = np.isfinite(number).all(axis=1) & (number[["latent_days", "infectious_days", "population"]] > 0).all(axis=1) & (number[["r0", "initial_infected", "t_max"]] >= 0).all(axis=1)
            if not good.all():
                yield failed(pdf[~good], "periods and population must be positive, and no parameter null or negative")
            for t_max, part in pdf[good].groupby("t_max"):
                for at in range(0, len(part), 64):
                    yield curves(part.iloc[at : at + 64], int(t_max))

    return scenarios.select(*columns).mapInPandas(run, CURVE)


def seir_summary(curves: DataFrame) -> DataFrame:
    """Per scenario: peak day and size of I, final_recovered, attack_rate, last day."""
    first = F.min_by(F.col("s") + F.col("e") + F.col("i") + F.col("r"), "day")
    return curves.groupBy("scenario_id").agg(F.max_by("day", F.struct("i", -F.col("day"))).alias("peak_day"), F.max("i").alias("peak_infectious"), F.max_by("r", "day").alias("final_recovered"), (F.max_by("r", "day") / first).alias("attack_rate"), F.max("day").alias("last_day"), F.max("error").alias("error"))


class SeirTable:
    """SELECT * FROM seir(r0, latent, infectious, population, infected, days)."""

    def eval(self, r0: float, latent: float, infectious: float, population: float, infected: float, days: int):
        c = curves_of(float(r0), float(latent), float(infectious), float(population), float(infected), int(days))[:, :, 0]
        for day, row in enumerate(c):
            yield day, *(float(v) for v in row)


def register(spark) -> None:
    spark.udtf.register("seir", F.udtf(SeirTable, returnType="day int, s double, e double, i double, r double, incidence double"))


FIT = "region string, pathogen string, r0 double, latent_days double, infectious_days double, rmse double, r_squared double, n long, error string"


#: Series that a task fits together; series-days of curves that it holds at once.
TOGETHER, CELLS = 256, 1 << 20


def fit_together(seen: np.ndarray, known: np.ndarray, people: np.ndarray, guess: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters, rmse and r_squared of series (rows; padded with days that aren't known), by one lock-step search."""
    count, days = seen.shape
    positive = seen > 0
    first = np.where(positive.any(1), seen[np.arange(count), positive.argmax(1)], 1.0)
    infected, n = np.floor(np.maximum(first, 1.0)), known.sum(1)

    def loss(which: np.ndarray, points: np.ndarray) -> np.ndarray:
        flat, own = points.reshape(-1, 3), np.repeat(which, points.shape[1])
        fine = (flat[:, 0] > 0) & (flat[:, 0] <= 50) & (flat[:, 1:] >= 0.25).all(1) & (flat[:, 1:] <= 100).all(1)
        out, good = np.full(len(flat), 1e10), np.flatnonzero(fine)
        for at in range(0, len(good), max(1, CELLS // days)):
            some = good[at : at + max(1, CELLS // days)]
            p, s = flat[some], own[some]
            model = epidemic.daily_infections(p[:, 0] / p[:, 2], 1 / p[:, 1], 1 / p[:, 2], people[s], infected[s], days - 1).T
            off = np.where(known[s], model - seen[s], 0.0)
            value = (off**2).sum(1) / n[s]
            out[some] = np.where(np.isfinite(model).all(1) & np.isfinite(value), value, 1e10)
        return out.reshape(points.shape[:2])

    p, _ = epidemic.nelder_mead(loss, guess, count)
    best = np.c_[np.clip(p[:, 0], 0.1, 30), np.clip(p[:, 1:], 0.5, 30)]
    rmse, r2 = np.zeros(count), np.zeros(count)
    for at in range(0, count, 64):
        s = slice(at, at + 64)
        off = np.where(known[s], curves_of(best[s, 0], best[s, 1], best[s, 2], people[s], infected[s], days - 1)[:, 4].T - seen[s], 0.0)
        rest, mean = (off**2).sum(1), (np.where(known[s], seen[s], 0.0).sum(1) / n[s])[:, None]
        total = np.where(known[s], (seen[s] - mean) ** 2, 0.0).sum(1)
        rmse[s], r2[s] = np.sqrt(rest / n[s]), np.where(total > 0, 1 - rest / np.where(total > 0, total, 1), 0.0)
    return best, rmse, r2


def fit_seir(df: DataFrame, guess: tuple[float, float, float] = (2.5, 5.2, 2.9), least: int = 7) -> DataFrame:
    """Reproduction number, latent and infectious days of each series, fitted to new_cases by simplex search over the
    days whose count is known; fewer than `least` of them, or no positive population, give nulls and the reason in error.
    A series is one row with its counts as an array; a task fits TOGETHER of them, of like length, in lock-step."""
    rows = df.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct(ORDER, F.col("new_cases").cast("double").alias("c")))), lambda x: x["c"]).alias("seen"), F.max(F.col("population").cast("double")).alias("people"))
    tasks = max(1, -(-df.select(*KEYS).distinct().count() // TOGETHER))
    names = [c.split()[0] for c in FIT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(n=pdf.seen.map(len)).sort_values("n", kind="stable")
            for at in range(0, len(pdf), TOGETHER):
                part = pdf.iloc[at : at + TOGETHER]
                seen = np.full((len(part), int(part.n.max())), np.nan)
                for k, x in enumerate(part.seen):
                    seen[k, : len(x)] = np.array(x, float)
                known, people = np.isfinite(seen), part.people.to_numpy(float)
                seen = np.where(known, seen, 0.0)
                peopled, enough = people > 0, known.sum(1) >= least
                good = peopled & enough
                out = part[KEYS].assign(r0=np.nan, latent_days=np.nan, infectious_days=np.nan, rmse=np.nan, r_squared=np.nan, n=part.n, error=np.where(~peopled, "population must be positive", np.where(~enough, f"fewer than {least} known days", None)))
                if good.any():
                    best, rmse, r2 = fit_together(seen[good], known[good], people[good], guess)
                    out.loc[good, ["r0", "latent_days", "infectious_days", "rmse", "r_squared"]] = np.c_[best, rmse, r2]
                yield out[names]

    return rows.repartition(tasks).mapInPandas(run, FIT)
