"""One boosted-tree forecast model over all series, and its roll-forward, as DataFrame operations.

Training. Lag features of all series, relative to each series' level, are cut into bins at quantiles, which Spark's
quantile sketch gives. A tree grows by levels: one aggregate of residual sums and row counts by (node, feature, bin) per
level, whose result is a few thousand numbers on the driver, however many rows there are. Tasks find the node of a batch of
rows and its sums with numpy, and send one number per node, feature and bin that occurs. Residuals are whole numbers of
2^-20, so sums don't depend on how rows are dealt: the same trees come out on any cluster. The state is written every few
trees, which cuts its lineage.

Roll-forward. The forest is one literal array; a series is a row with its last values, a ring of 14. Each step derives the
next day's features from the ring, walks the trees, and pushes its value: `horizon` steps are one narrow expression.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outbreak_spark.model import KEYS, ORDER, series
from outbreak_spark.operators.features import feature_names, lag_features
from outbreak_spark.operators.forecast import LEAST_ROWS
from outbreak_spark.shared import drop, new_folder, written

#: Units of residuals; trees after which the state is written.
FIXED, KEEP = 1 << 20, 8
FOREST = "array<struct<feature:array<int>,cut:array<double>,value:array<bigint>>>"


@dataclass
class Tree:
    """A binary tree in heap order: children of node k are 2k + 1 and 2k + 2; feature -1 is a leaf (or no node)."""

    feature: list[int]
    bin: list[int]
    cut: list[float]
    value: list[int]
    gain: list[float]

    @classmethod
    def of(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls([-1] * n, [0] * n, [0.0] * n, [0] * n, [0.0] * n)

    def plain(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """feature, bin and value, for tasks."""
        return tuple(np.array(x) for x in (self.feature, self.bin, self.value))


def placed(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node where each row is after so many levels."""
    node, at = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(levels):
        f = feature[node]
        node = np.where(f < 0, node, 2 * node + np.where(bins[at, f] <= cut[node], 1, 2))
    return node


@dataclass
class Forest:
    names: list[str]
    edges: list[list[float]]
    depth: int
    base: int = 0
    trees: list[Tree] = field(default_factory=list)

    def importance(self) -> dict[str, float]:
        """Mean gain per split of each feature, summing to 1; all alike if there is no split."""
        gain, splits = np.zeros(len(self.names)), np.zeros(len(self.names))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    gain[f] += g
                    splits[f] += 1
        mean = gain / np.maximum(splits, 1)
        mean = mean / mean.sum() if mean.sum() else np.full(len(mean), 1 / len(mean))
        return dict(zip(self.names, mean.tolist(), strict=True))

    def column(self) -> Column:
        """As one constant."""
        return F.from_json(F.lit(json.dumps([{"feature": t.feature, "cut": t.cut, "value": t.value} for t in self.trees])), FOREST)

    def predict(self, x: Column, forest: Column) -> Column:
        """Of an array of features, in units of the level."""

        def node(t: Column) -> Column:
            down = lambda k, _: F.when(F.get(t["feature"], k) < 0, k).otherwise(2 * k + F.when(F.get(x, F.get(t["feature"], k)) <= F.get(t["cut"], k), 1).otherwise(2))
            return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), down)

        return F.aggregate(forest, F.lit(self.base).cast("long"), lambda total, t: total + F.get(t["value"], node(t))) / float(FIXED)


def is_relative(name: str) -> bool:
    """Whether a feature is a number of cases, and so counts relative to its series' level."""
    return name.startswith(("lag_", "rolling_")) or name == "day_change"


def examples(df: DataFrame, n_lags: int = 14, test_size: int = 14) -> DataFrame:
    """Keys, record_index, level, held (one of the last test_size), x (features by feature_names(), relative to the level) and y
    (whole numbers) of series with enough records. level: mean of the target before those, 1 at least."""
    names, w = feature_names(n_lags), Window.partitionBy(*KEYS)
    x = lag_features(df, n_lags)
    x = x.withColumn("held", F.row_number().over(series().orderBy(F.desc(ORDER))) <= test_size).withColumn("rows", F.count("*").over(w)).where(F.col("rows") >= LEAST_ROWS)
    x = x.withColumn("level", F.greatest(F.avg(F.when(~F.col("held"), F.col("target"))).over(w), F.lit(1.0)))
    values = F.array(*((F.col(n) / F.col("level") if is_relative(n) else F.col(n).cast("double")) for n in names))
    return x.select(*KEYS, ORDER, "level", "held", values.alias("x"), F.round(F.col("target") / F.col("level") * FIXED).cast("long").alias("y"))


def quantile_edges(rows: DataFrame, names: list[str], bins: int) -> list[list[float]]:
    """At most bins - 1 ascending cuts per feature: its quantiles, by one aggregate of mergeable sketches."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(F.col("x")[k], shares, 100 * bins).alias(f"q{k}") for k in range(len(names)))).first()
    return [sorted(set(q)) if q else [] for q in found]


def best_split(n: np.ndarray, g: np.ndarray, columns: list[int], least: int, l2: float) -> tuple[float, int, int] | None:
    """Gain, feature and bin of a node's best cut, given row counts and residual sums by feature and bin; ties go to the first
    feature, then the first bin."""
    left_n, left_g = n.cumsum(1), g.cumsum(1)
    all_n, all_g = int(n[columns[0]].sum()), int(g[columns[0]].sum())
    right_n, right_g = all_n - left_n, all_g - left_g
    gain = left_g.astype(float) ** 2 / (left_n + l2) + right_g.astype(float) ** 2 / (right_n + l2) - float(all_g) ** 2 / (all_n + l2)
    gain[(left_n < least) | (right_n < least)] = -np.inf
    own = np.full(len(n), False)
    own[columns] = True
    gain[~own] = -np.inf
    k = int(gain.argmax())
    f, b = divmod(k, n.shape[1])
    return (float(gain[f, b]), f, b) if gain[f, b] > 1e-6 * FIXED else None


def grow(histogram: Callable[[Tree, list[int]], dict[int, tuple[np.ndarray, np.ndarray]]], edges: list[list[float]], columns: list[int], depth: int, rate: float, least: int, l2: float) -> Tree:
    """A tree by levels. histogram: of the nodes asked for, counts and sums by feature and bin."""
    tree, active = Tree.of(depth), [0]
    worth = lambda n, g: int(round(rate * g / (n + l2)))
    for level in range(depth):
        found, following = histogram(tree, active), []
        for k in active:
            if k not in found:
                continue
            n, g = found[k]
            if level == 0:
                tree.value[0] = worth(int(n[0].sum()), int(g[0].sum()))
            best = best_split(n, g, columns, least, l2)
            if best is None:
                continue
            tree.gain[k], tree.feature[k], tree.bin[k] = best
            f, b = best[1:]
            tree.cut[k] = edges[f][b]
            for child, part in ((2 * k + 1, slice(0, b + 1)), (2 * k + 2, slice(b + 1, None))):
                tree.value[child] = worth(int(n[f, part].sum()), int(g[f, part].sum()))
                following.append(child)
        active = following
        if not active:
            break
    return tree


def residuals(batch: pa.RecordBatch, trees: tuple, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins of a batch as a matrix, and its residuals after the trees."""
    r = batch.column("r").to_numpy()
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(len(r), -1)
    for feature, cut, value in trees:
        r = r - value[placed(bins, feature, cut, depth)]
    return bins, r


def summed(trees: tuple, now: tuple, level: int, depth: int, features: int, size: int) -> Callable:
    """Of the rows at a level of the tree `now`: counts n and residual sums g by (node, feature, bin), numbered from 0 as `at`."""

    def run(batches):
        cells = (features * size) << level
        n, g = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for batch in batches:
            if len(batch):
                bins, r = residuals(batch, trees, depth)
                node = placed(bins, *now[:2], level) - ((1 << level) - 1)
                here = node >= 0
                at = ((node[here, None] * features + np.arange(features)) * size + bins[here]).ravel()
                n += np.bincount(at, minlength=cells)
                # Halves of the residuals, as sums of doubles are exact up to 2^53 only.
                high, low = np.divmod(np.repeat(r[here], features), 1 << 20)
                g += (np.bincount(at, high, cells).astype(np.int64) << 20) + np.bincount(at, low, cells).astype(np.int64)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at]), pa.array(g[at])], ["at", "n", "g"])

    return run


def left(trees: tuple, depth: int) -> Callable:
    """Rows of the state with their residuals after the trees."""

    def run(batches):
        for batch in batches:
            if len(batch):
                yield batch.set_column(batch.schema.get_field_index("r"), "r", pa.array(residuals(batch, trees, depth)[1], pa.int64()))

    return run


def train(rows: DataFrame, n_lags: int = 14, trees: int = 200, depth: int = 6, rate: float = 0.1, sample: float = 0.8, features: float = 0.8, least: int = 3, l2: float = 1.0, bins: int = 64, seed: int = 42) -> tuple[Forest, DataFrame]:
    """The model, and examples() with their residuals r under it. Held-out rows don't train. sample, features: shares of rows (by
    hash of series and record) and of features that a tree sees. No rows: a model that says 0."""
    spark, names, rng = rows.sparkSession, feature_names(n_lags), np.random.default_rng(seed)
    at, kept = new_folder(spark, "pooled"), 0
    rows = written(rows, f"{at}/examples")
    own = rows.where(~F.col("held"))
    forest = Forest(names, quantile_edges(own, names, bins), depth)
    size = own.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    forest.base = round(size.y / size.n) if size.n else 0
    edges = F.from_json(F.lit(json.dumps(forest.edges)), "array<array<double>>")
    # A byte per feature: the number of cuts below its value, as two hexadecimal digits.
    digits = F.transform(F.arrays_zip(F.col("x").alias("v"), edges.alias("e")), lambda p: F.lpad(F.hex(F.size(F.filter(p["e"], lambda e: e < p["v"]))), 2, "0"))
    state = rows.select(*KEYS, ORDER, "level", "held", F.unhex(F.array_join(digits, "")).alias("bins"), (F.col("y") - forest.base).alias("r"))
    state = written(state, f"{at}/state0").persist()
    pending: list[tuple] = []  # trees since the state was written
    for t in range(trees if size.n else 0):
        chosen = F.pmod(F.xxhash64(*KEYS, ORDER, F.lit(str(seed + t))), F.lit(1000)) < round(1000 * sample)
        columns = sorted(rng.permutation(len(names))[: max(1, round(features * len(names)))].tolist())
        own = state.where(~F.col("held") & chosen).select("r", "bins")

        def histogram(tree: Tree, active: list[int], own: DataFrame = own, pending: tuple = tuple(pending)) -> dict[int, tuple[np.ndarray, np.ndarray]]:
            level, now = (active[0] + 1).bit_length() - 1, tree.plain()
            found = own.mapInArrow(summed(pending, now, level, depth, len(names), bins), "at long, n long, g long")
            total = found.groupBy("at").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).toArrow()  # nodes x features x bins at most
            shape, first = (1 << level, len(names), bins), (1 << level) - 1
            n, g = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
            for to, name in ((n, "n"), (g, "g")):
                to.ravel()[total.column("at").to_numpy()] = total.column(name).to_numpy()
            return {k: (n[k - first], g[k - first]) for k in active if n[k - first].any()}

        tree = grow(histogram, forest.edges, columns, depth, rate, least, l2)
        forest.trees.append(tree)
        pending.append(tree.plain())
        if len(pending) == KEEP or t + 1 == trees:
            kept += 1
            fresh = written(state.mapInArrow(left(tuple(pending), depth), state.schema), f"{at}/state{kept}").persist()
            state.unpersist()
            drop(spark, f"{at}/state{kept - 1}")
            state, pending = fresh, []
    state.unpersist()
    return forest, state


def features_of(ring: Column, day: Column, n_lags: int) -> list[Column]:
    """Features of the day after the last values `ring`, as lag_features has them."""
    last = lambda k: F.element_at(ring, -k)
    out = [last(k) for k in range(1, n_lags + 1)]
    add = lambda a, v: a + v
    for d in (7, 14):
        own = F.slice(ring, -d, d)
        mean = F.aggregate(own, F.lit(0.0), add) / d
        squares = F.aggregate(F.transform(F.arrays_zip(own.alias("v"), F.array_repeat(mean, d).alias("m")), lambda p: (p["v"] - p["m"]) * (p["v"] - p["m"])), F.lit(0.0), add)
        out += [mean, F.sqrt(squares / (d - 1)), F.array_min(own), F.array_max(own)]
    ratio = F.when(last(7) > 0, last(1) / F.when(last(7) > 0, last(7))).otherwise(1.0)
    weekday = F.weekday(day)
    return [*out, last(1) - last(2), ratio, weekday.cast("double"), F.month(day).cast("double"), F.when(weekday >= 5, 1.0).otherwise(0.0)]


def roll_forward(ends: DataFrame, forest: Forest, horizon: int, n_lags: int = 14) -> DataFrame:
    """Adds path (array of predicted cases, one per day) to rows of series: ring (their last values, 14 or n_lags at least),
    last_date and level."""
    names = feature_names(n_lags)

    def step(s: Column, k: Column) -> Column:
        raw = features_of(s["ring"], F.date_add("last_date", k), n_lags)
        x = F.array(*((c / F.col("level") if is_relative(n) else c) for n, c in zip(names, raw, strict=True)))
        # Bound once, as the trees look at it again and again.
        y = F.transform(F.array(x), lambda v: F.greatest(F.lit(0.0), forest.predict(v, F.col("forest")) * F.col("level")))[0]
        push = lambda v: F.struct(F.concat(F.slice(s["ring"], F.lit(2), F.size(s["ring"]) - 1), F.array(v)).alias("ring"), F.array_append(s["path"], v).alias("path"))
        return F.transform(F.array(y), push)[0]

    start = F.struct(F.col("ring"), F.array().cast("array<double>").alias("path"))
    with_forest = ends.withColumn("forest", forest.column())
    return with_forest.withColumn("path", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda s: s["path"])).drop("forest")


def forecast(df: DataFrame, horizon: int = 14, n_lags: int = 14, test_size: int = 14, **options) -> tuple[DataFrame, Forest]:
    """A row per series and step, as forecast.forecast() has them, model `pooled`: date, predicted, lower and upper (1.96 deviations of
    the series' held-out errors), rmse, mae; and the model. Null counts are 0. Series with fewer than LEAST_ROWS feature rows
    give none. options: of train()."""
    filled = df.select(*KEYS, ORDER, F.col("date").cast("date").alias("date"), F.coalesce("new_cases", F.lit(0)).alias("new_cases"))
    forest, state = train(examples(filled, n_lags, test_size), n_lags, **options)
    off = F.col("r") / float(FIXED) * F.col("level")
    errors = state.where("held").groupBy(*KEYS).agg(F.first("level").alias("level"), F.stddev_pop(off).alias("deviation"), F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(F.abs(off)).alias("mae"))
    recent = F.collect_list(F.col("new_cases").cast("double")).over(series().rowsBetween(1 - max(14, n_lags), 0))
    ends = filled.select(*KEYS, ORDER, "date", recent.alias("ring")).groupBy(*KEYS).agg(F.max_by("ring", ORDER).alias("ring"), F.max_by("date", ORDER).alias("last_date"))
    rolled = roll_forward(ends.join(errors, KEYS), forest, horizon, n_lags).select("*", F.posexplode("path").alias("k", "predicted"))
    band = 1.96 * F.col("deviation")
    out = rolled.select(
        *KEYS, F.lit("pooled").alias("model"), (F.col("k") + 1).alias("step"), F.date_add("last_date", F.col("k") + 1).alias("date"), "predicted", F.greatest(F.lit(0.0), F.col("predicted") - band).alias("lower"), (F.col("predicted") + band).alias("upper"), "rmse", "mae", F.from_json(F.lit(json.dumps(forest.importance())), "map<string,double>").alias("importance")
    )
    return out, forest


def importance(spark, forest: Forest, most: int = 15) -> DataFrame:
    """rank, feature, importance of the features that matter most, ties by order of the features."""
    weights = list(forest.importance().items())
    top = sorted(range(len(weights)), key=lambda k: (-weights[k][1], k))[:most]
    return spark.createDataFrame([(rank, *weights[k]) for rank, k in enumerate(top, 1)], "rank int, feature string, importance double")
