"""The pooled forecast model: its trees against a one-process booster, its roll-forward against a loop over series."""

import datetime

import numpy as np
import pytest
from outbreak_spark.model import KEYS
from outbreak_spark.operators import forecast, pooled
from outbreak_spark.operators.features import feature_names
from outbreak_spark.operators.forecast import next_row

START = datetime.date(2024, 1, 1)
ROWS = "region string, pathogen string, record_index long, date date, new_cases long, source string"


@pytest.fixture(scope="module")
def daily(spark):
    rng, rows = np.random.default_rng(3), []
    for s in range(6):
        x = (20 * (s + 1)) * (1 + 0.5 * np.sin(np.arange(70) / 9 + s)) * np.where(np.arange(70) % 7 >= 5, 0.6, 1.0) + rng.normal(0, 3, 70)
        rows += [(f"r{s}", "flu", k, START + datetime.timedelta(days=k), int(max(0, v)), "t") for k, v in enumerate(x)]
    rows += [("short", "flu", k, START + datetime.timedelta(days=k), 5, "t") for k in range(30)]
    rows += [("flat", "flu", k, START + datetime.timedelta(days=k), 0, "t") for k in range(60)]
    rows += [("holes", "flu", k, START + datetime.timedelta(days=k), None if k % 9 == 4 else 7 + k % 5, "t") for k in range(60)]
    return spark.createDataFrame(rows, ROWS).repartition(3)


def one_process(x, y, edges, depth, trees, rate, least, l2, columns_of, sample_of):
    """Boosting by plain loops: a list of trees, each a dict of node -> (feature, cut) or value, and the residuals."""
    b = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], 1)
    base = round(int(y.sum()) / len(y))
    r, out = y - base, []
    for t in range(trees):
        use, tree = sample_of(t), {}

        def split(rows, k, level, t=t, tree=tree):
            g, n = int(r[rows].sum()), len(rows)
            tree[k] = int(round(rate * g / (n + l2)))
            best = None
            if level < depth:
                for f in columns_of[t]:
                    for c in range(len(edges[f])):
                        left = rows[b[rows, f] <= c]
                        if least <= len(left) <= n - least:
                            a = int(r[left].sum())
                            gain = float(a) ** 2 / (len(left) + l2) + float(g - a) ** 2 / (n - len(left) + l2) - float(g) ** 2 / (n + l2)
                            if best is None or gain > best[0]:
                                best = gain, f, c, left
            if best and best[0] > 1e-6 * pooled.FIXED:
                gain, f, c, left = best
                tree[k] = (f, edges[f][c])
                split(left, 2 * k + 1, level + 1)
                split(np.setdiff1d(rows, left), 2 * k + 2, level + 1)

        split(np.flatnonzero(use), 0, 0)
        out.append(tree)
        for i in range(len(y)):
            k = 0
            while isinstance(tree[k], tuple):
                k = 2 * k + (1 if x[i, tree[k][0]] <= tree[k][1] else 2)
            r[i] -= tree[k]
    return base, out, r


def test_trees_are_those_of_one_process(spark, daily):
    rows = pooled.examples(daily).cache()
    options = {"trees": 9, "depth": 3, "bins": 8, "rate": 0.3, "features": 0.5, "sample": 1.0}
    forest, state = pooled.train(rows, **options)
    own = rows.orderBy(*KEYS, "record_index").toPandas()
    train = own[~own.held]
    assert set(train.region) == {*(f"r{s}" for s in range(6)), "flat"} | ({"holes"} & set(train.region))
    rng = np.random.default_rng(42)
    columns = [sorted(rng.permutation(27)[:14].tolist()) for _ in range(9)]
    x, y = np.stack(train.x), train.y.to_numpy().copy()
    base, trees, left = one_process(x, y, forest.edges, 3, 9, 0.3, 3, 1.0, columns, lambda t: np.ones(len(y), bool))
    assert forest.base == base and len(forest.trees) == 9
    for tree, want in zip(forest.trees, trees, strict=True):
        for k, v in want.items():
            assert ((tree.feature[k], tree.cut[k]) if isinstance(v, tuple) else tree.value[k]) == v
        assert sum(f >= 0 for f in tree.feature) == sum(isinstance(v, tuple) for v in want.values())
    assert [r.r for r in state.where("not held").orderBy(*KEYS, "record_index").collect()] == left.tolist()
    weights = forest.importance()
    assert abs(sum(weights.values()) - 1) < 1e-12 and [r.feature for r in pooled.importance(spark, forest, 3).orderBy("rank").collect()][0] == max(weights, key=weights.get)


def test_model_doesnt_depend_on_the_deal(spark, daily):
    options = {"trees": 3, "depth": 3, "bins": 16}
    one, two = (pooled.train(pooled.examples(df), **options)[0] for df in (daily, daily.repartition(7, "record_index")))
    assert one == two


def test_roll_forward_equals_a_loop(spark, daily):
    out, forest = pooled.forecast(daily, horizon=10, trees=12, depth=4, bins=16)
    got = out.orderBy(*KEYS, "step").toPandas()
    assert sorted(set(got.region)) == ["flat", "holes", *(f"r{s}" for s in range(6))] and (got.groupby("region").size() == 10).all()
    names, rows = feature_names(), daily.toPandas().sort_values(["region", "record_index"])
    relative = np.array([pooled.is_relative(n) for n in names])

    def predict(v):
        total = forest.base
        for t in forest.trees:
            k = 0
            while t.feature[k] >= 0:
                k = 2 * k + (1 if v[t.feature[k]] <= t.cut[k] else 2)
            total += t.value[k]
        return total / pooled.FIXED

    for region, own in rows.groupby("region"):
        if region == "short":
            continue
        history, dates = own.new_cases.fillna(0).to_numpy(float), list(own.date)
        level = max(1.0, history[14:-14].mean())
        off = []
        for k in range(len(history) - 14, len(history)):
            v = np.array(next_row(history[:k], dates[k], 14), float)
            off.append(history[k] - level * predict(np.where(relative, v / level, v)))
        mine = got[got.region == region]
        assert np.allclose(mine.rmse, np.sqrt(np.mean(np.square(off))), atol=1e-4) and np.allclose(mine.mae, np.mean(np.abs(off)), atol=1e-4)
        for k in range(1, 11):
            day = dates[-1] + datetime.timedelta(days=k)
            v = np.array(next_row(history, day, 14), float)
            y = max(0.0, level * predict(np.where(relative, v / level, v)))
            history = np.append(history, y)
            r = mine.iloc[k - 1]
            assert r.step == k and r.date == day and abs(r.predicted - y) < 1e-9 * max(1, y)
            band = 1.96 * np.std(off)
            assert abs(r.upper - (y + band)) < 1e-3 and abs(r.lower - max(0, y - band)) < 1e-3


def test_plan_of_the_roll_forward_is_narrow(spark, daily):
    out, _ = pooled.forecast(daily, horizon=3, trees=2, depth=2, bins=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_nothing_to_train_on(spark, daily):
    out, forest = pooled.forecast(daily.where("region = 'short'"), trees=2, depth=2)
    assert out.count() == 0 and forest.trees == [] and len(set(forest.importance().values())) == 1


def test_ensemble_takes_the_pooled_model(spark, daily):
    one = daily.where("region = 'r1'")
    out, _ = pooled.forecast(daily, horizon=3, trees=2, depth=2)
    both = forecast.forecast(one, horizon=3, models=("weekly",)).unionByName(out.where("region = 'r1'"))
    got = forecast.ensemble(both).orderBy("step").collect()
    assert [r.step for r in got] == [1, 2, 3] and {r.model for r in got} == {"Ensemble (pooled + weekly)"} and all(r.predicted >= 0 for r in got)
