import random

import numpy as np
import pytest
from outbreak_spark.llm import ann, topk
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(v) for v in x / np.linalg.norm(x)]) for k, x in enumerate(rng.normal(size=(400, 16)))]
    rows += [(k, rows[7][1]) for k in range(400, 460)]  # ties
    rows += [(500, None), (501, []), (502, [1.0]), (503, [float("nan")] * 16), (504, [None] * 16), (505, [0.0] * 16), (None, rows[0][1]), (20, rows[1][1]), (600, [float("inf")] * 16)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(3)


def pairs(df, zero):
    keep = [(r.vec_id, np.array(r.embedding)) for r in df.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 16 and all(v is not None and np.isfinite(v) for v in r.embedding)]
    return [(k, x) for k, x in keep if zero or x.any()]


@pytest.mark.parametrize("held", [{}, {"candidates": 50, "queries": 20}])
def test_top_k(vectors, held):
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(vectors, F.col("vec_id") % 10 == 0, k=5, **held).collect()}
    rows = [(k, np.floor(256 * x).astype(np.int64)) for k, x in pairs(vectors, True)]
    queries = {}
    for k, x in pairs(vectors, True):
        if k % 10 == 0:
            queries[k] = min(queries.get(k, x.tolist()), x.tolist())
    want = {}
    for k, x in queries.items():
        q = np.floor(256 * np.array(x)).astype(np.int64)
        best = sorted((-int(q @ y), j) for j, y in rows if j != k)[:5]
        want |= {(k, r + 1): (j, -s) for r, (s, j) in enumerate(best)}
    assert got == want


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 256 * 1)]
    for f in (topk.top_k, ann.nearest):
        assert f(df.limit(0), F.col("vec_id") == 0).count() == 0 and f(df, F.lit(False)).count() == 0


def test_large_values_stay_exact():
    rng = np.random.default_rng(2)
    x, q = rng.integers(-(2**29), 2**29, (300, 8)), rng.integers(-(2**29), 2**29, (9, 8))
    t = topk.DualTree(x.astype(float), np.arange(300), q.astype(float), np.arange(1000, 1009), 5)
    t.run()
    assert not t.exact_in_double and (t.best == -np.sort(-(q @ x.T), axis=1)[:, :5]).all()


def test_huge_components(spark):
    df = spark.createDataFrame([(0, [1.7e308, 1.0]), (1, [1.7e308, 2.0]), (2, [-1.7e308, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0, k=2).orderBy("rank").collect()] == [(1, 2**63 - 1), (3, 2**63 - 1)]
    df = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 2 - 2**63)]


def test_pruning_leaves_pairs_out():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-3, 4, (400, 4)) + 1000 * np.array(c) for c in ([1, 0, 0, 0], [-1, 0, 0, 0], [0, 1, 0, 0], [0, -1, 0, 0])]).astype(float)
    t = topk.DualTree(x, np.arange(1600), x[:50], np.arange(5000, 5050), 5)
    t.run()
    assert t.scored < 50 * 1600 / 2 and (t.best == -np.sort(-(x[:50] @ x.T), axis=1)[:, :5]).all()


def test_tree_is_a_cover_tree():
    x = np.random.default_rng(4).normal(size=(3000, 3)) * 100
    todo, some = [topk.Node(x, np.arange(3000))], 0
    while todo:
        node = todo.pop()
        if not node.children and node.crumbs is None:
            continue
        centres = np.array([c.points[0] for c in node.children] + (node.crumbs[0].tolist() if node.crumbs else []), int)
        inside = [c.points for c in node.children] + ([node.crumbs[2]] if node.crumbs else [])
        assert sorted(np.concatenate(inside)) == sorted(node.points) and all(c.radius <= node.radius / 2 + 1e-6 for c in node.children)
        apart = np.sqrt(((x[centres][:, None] - x[centres][None]) ** 2).sum(2)) + np.eye(len(centres)) * 1e9
        assert apart.min() > node.radius / 2 - 1e-6
        if node.crumbs:
            own = node.crumbs[0][node.crumbs[3]]
            assert (np.sqrt(((x[node.crumbs[2]] - x[own]) ** 2).sum(1)) <= node.crumbs[1][node.crumbs[3]]).all() and node.crumbs[1].max() <= node.radius / 2 + 1e-6
        todo += node.children
        some += 1
    assert some > 3


@pytest.mark.parametrize("held", [{}, {"candidates": 100, "queries": 20}])
def test_ann(vectors, held):
    got = ann.nearest(vectors, F.col("vec_id") % 10 == 0, k=20, rerank=96, **held).collect()
    rows = pairs(vectors, False)
    vec = {}
    for k, x in rows:
        vec.setdefault(k, []).append(x)
    hits = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    for k, found in by.items():
        q = min(vec[k], key=lambda x: x.tolist())
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and all(min(abs(float(q @ x) - r.score) for x in vec[r.vec_id]) < 1e-9 for r in found)
        assert all((-a.score, a.vec_id) <= (-b.score, b.vec_id) for a, b in zip(found, found[1:], strict=False)) and k not in [r.vec_id for r in found]
        best = sorted((-float(q @ x), j) for j, x in rows if j != k)[:20]
        hits += len({j for _, j in best} & {r.vec_id for r in found})
        total += 20
    assert hits / total >= 0.9


def test_anisotropic_codes_keep_scores_better():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def along(book):
        codes = book.encode(x)
        near = np.stack([book.centres[m][codes[:, m]] for m in range(book.parts)], 1).reshape(len(x), -1)[:, :32]
        return np.mean(((x - near) * x).sum(1) ** 2)

    assert along(ann.Codebook(x, threshold=0.4)) < along(ann.Codebook(x, threshold=0.0))
