"""Online estimates: daily counts of an event stream, and stateful reproduction numbers and changepoints."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from outbreak_spark.kernels.gamma import gamma_quantile
from outbreak_spark.model import KEYS
from outbreak_spark.operators.changepoint import RunLengths


def daily_counts(events: DataFrame, delay: str = "3 days", region: Column | None = None, pathogen: Column | None = None, at: str = "ts") -> DataFrame:
    """region, pathogen, day, new_cases; a day is final when events are `delay` past its end. Works on batches too.
    region, pathogen, at: what gives an event's series and time (default: those of the events table)."""
    region = F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")) if region is None else region
    keyed = events.select(region.alias("region"), (F.col("event_type") if pathogen is None else pathogen).alias("pathogen"), F.col(at).alias("ts"))
    return keyed.withWatermark("ts", delay).groupBy(*KEYS, F.window("ts", "1 day")).agg(F.count("*").alias("new_cases")).select(*KEYS, F.to_date("window.start").alias("day"), "new_cases")


def filled(rows: pd.DataFrame, last: datetime.date | None, late: list[datetime.date]) -> Iterator[tuple[datetime.date, float]]:
    """(day, cases) of a series' next days; days without events, since the last one seen too, count 0. Days that come when
    a later one, or themselves, have been seen already go to `late`."""
    for r in rows.sort_values("day").itertuples(index=False):
        if last is not None and r.day <= last:
            late.append(r.day)
            continue
        while last is not None and (last := last + datetime.timedelta(days=1)) < r.day:
            yield last, 0.0
        last = r.day
        yield r.day, float(r.new_cases)


RT = "region string, pathogen string, day date, rt_mean double, rt_lower double, rt_upper double, late boolean"


def stream_rt(counts: DataFrame, weights: list[float], window: int = 7, prior: tuple[float, float] = (1.0, 5.0), confidence: float = 0.95) -> DataFrame:
    """A row per finished day of a stream of daily counts, days without events included once a later one is there; and
    one with late set, without an estimate, for each count that came too late to be used.
    State: the last day and the last counts, one list per series."""
    keep, tail = len(weights) - 1 + window, (1 - confidence) / 2

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last, past = (state.get[0], datetime.date.fromisoformat(state.get[1]), list(state.get[2])) if state.exists else (0, None, [])
        out, late = [], []
        for last, cases in filled(pd.concat(list(batches)), last, late):  # noqa: B020
            past.append(cases)
            past, seen = past[-keep:], seen + 1
            if seen <= window:
                continue
            lam = [sum(weights[s] * past[t - s] for s in range(1, len(weights)) if t - s >= 0) for t in range(len(past) - window, len(past))]
            if sum(lam) > 0:
                shape, scale = prior[0] + sum(past[-window:]), 1 / (1 / prior[1] + sum(lam))
                low, high = (float(gamma_quantile(p, [shape], scale)[0]) for p in (tail, 1 - tail))
                out.append((*key, last, shape * scale, low, high, False))
        out += [(*key, day, None, None, None, True) for day in late]
        state.update((seen, last.isoformat(), past))
        yield pd.DataFrame(out, columns=["region", "pathogen", "day", "rt_mean", "rt_lower", "rt_upper", "late"])

    return counts.groupBy(*KEYS).applyInPandasWithState(run, RT, "seen long, last string, past array<double>", "append", GroupStateTimeout.NoTimeout)


CHANGE = "region string, pathogen string, day date, changepoint_prob double, map_run_length int, expected_run_length double, late boolean"


def stream_changepoints(counts: DataFrame, hazard_lambda: float = 100.0) -> DataFrame:
    """A row per finished day, as stream_rt(). State: the last day and the run-length posterior, cut where its tail has no
    mass."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import numpy as np

        own, last = RunLengths(hazard_lambda), None
        if state.exists:
            day, *parts = state.get
            last = datetime.date.fromisoformat(day)
            own.p, own.mu, own.kappa, own.alpha, own.beta = (np.array(v) for v in parts)
        out, late = [], []
        for last, cases in filled(pd.concat(list(batches)), last, late):  # noqa: B020
            out.append((*key, last, *own.step(float(np.log1p(max(cases, 0)))), False))
        out += [(*key, day, None, None, None, True) for day in late]
        state.update((last.isoformat(), *(v.tolist() for v in (own.p, own.mu, own.kappa, own.alpha, own.beta))))
        yield pd.DataFrame(out, columns=["region", "pathogen", "day", "changepoint_prob", "map_run_length", "expected_run_length", "late"]).astype({"map_run_length": "Int32"})

    schema = "last string, " + ", ".join(f"{c} array<double>" for c in ("p", "mu", "kappa", "alpha", "beta"))
    return counts.groupBy(*KEYS).applyInPandasWithState(run, CHANGE, schema, "append", GroupStateTimeout.NoTimeout)
