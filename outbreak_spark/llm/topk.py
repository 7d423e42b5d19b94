"""Exact top-k inner-product search with two cover trees.

Candidates and queries are each put into a cover tree: a node has a centre, one of its points, and the covering radius
of its points; its children's centres are a net of it, more than half its radius apart, and each child covers at most
that half. A pair of nodes is left out if no query in one can score as high with a point in the other as the worst k-th
score among those queries; children that are small are bounded and scored together, by one matrix product.

Over the cluster, the tree's top level is a bounded number of pivots. A candidate belongs to its nearest one, and large
pivots are several blocks. A query first goes to one block of its best pivot, which gives it a k-th score to beat, and
then to the blocks of all other pivots whose covering radius doesn't exclude that.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outbreak_spark.llm.common import Workspace, plain, rebuilt
from outbreak_spark.llm.vectors import dealt, every, matrix, queries_of, ranked, valid

LEAF = 64
#: Candidates and queries that one task holds; pivots at most.
CANDIDATES, QUERIES, PIVOTS = 8192, 16384, 1024
LEAST = -np.iinfo(np.int64).max  # its negative is an int64 too


def shrunk(largest: float, scale: float) -> float:
    """A power of two that takes components whose squares would leave the range of doubles back into it; else 1."""
    return 1.0 if scale * largest < 1e100 else 2.0 ** -(math.frexp(largest)[1] + math.frexp(scale)[1])


def reach(scores: np.ndarray, shrink: float) -> np.ndarray:
    """What a bound between vectors times `shrink` must reach to hold such a score. Scores that stop at the least number
    may all be ties."""
    return scores if shrink == 1 else np.where(scores <= LEAST + 1, -np.inf, scores * shrink * shrink)


def net(points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres (the first is point 0) more than `radius` apart that cover all points; each point's centre, and its
    distance to it. Points are taken in chunks: one matrix product against the centres so far."""
    n, square = len(points), (points**2).sum(1)
    home, away = np.zeros(n, np.int64), np.full(n, np.inf)
    centres: list[int] = []

    for lo in range(0, n, 256):
        rows = np.arange(lo, min(lo + 256, n))
        have = np.array(centres, np.int64)
        for k in range(0, len(have), 4096):
            some = have[k : k + 4096]
            d = np.sqrt(np.maximum(square[rows][:, None] + square[some][None] - 2 * points[rows] @ points[some].T, 0))
            at = d.argmin(1)
            least = d[np.arange(len(rows)), at]
            closer = least < away[rows]
            home[rows[closer]], away[rows[closer]] = k + at[closer], least[closer]
        among = np.sqrt(np.maximum(square[rows][:, None] + square[rows] - 2 * points[rows] @ points[rows].T, 0))
        for k, x in enumerate(rows):
            if away[x] > radius:
                closer = among[k] < away[rows]
                home[rows[closer]], away[rows[closer]] = len(centres), among[k][closer]
                home[x], away[x] = len(centres), 0.0
                centres.append(int(x))
    chosen = np.array(centres, np.int64)
    # Later centres may be nearer to earlier points; covering holds without that. Distances anew, without cancellation.
    return chosen, home, np.sqrt(((points - points[chosen][home]) ** 2).sum(1))


class Node:
    """points[0] is the centre. children: nodes of more than LEAF points; crumbs: of the others, each child's centre and
    radius, and their points with the child that each belongs to."""

    __slots__ = ("center", "norm", "radius", "points", "children", "crumbs")

    def __init__(self, data: np.ndarray, points: np.ndarray):
        self.points, self.children, self.crumbs = points, [], None
        self.center = data[points[0]]
        self.norm = float(np.sqrt(self.center @ self.center))
        away = np.sqrt(((data[points] - self.center) ** 2).sum(1))
        self.radius = float(away.max())
        if len(points) <= LEAF or self.radius == 0:
            return
        centres, home, away = net(data[points], self.radius / 2)
        size = np.bincount(home, minlength=len(centres))
        for k in np.flatnonzero(size > LEAF):
            own = points[home == k]
            own = np.r_[points[centres[k]], own[own != points[centres[k]]]]
            self.children.append(Node(data, own))
        few = np.flatnonzero(size <= LEAF)
        if len(few):
            mine = np.flatnonzero(size[home] <= LEAF)
            radius = np.zeros(len(centres))
            np.maximum.at(radius, home, away)
            number = np.full(len(centres), -1)
            number[few] = np.arange(len(few))
            self.crumbs = points[centres[few]], radius[few] * (1 + 1e-9) + 1e-9, points[mine], number[home[mine]]


class DualTree:
    """Each query's k best by integer inner product, ties to the smaller id; its own id left out. floor: scores to reach. shrink:
    the trees and bounds are of vectors times that."""

    def __init__(self, data: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray | None = None, shrink: float = 1.0):
        self.x, self.q, self.ids, self.query_ids, self.k = data, queries, ids, query_ids, k
        largest = max(float(np.abs(data).max(initial=0)), 1.0) * max(float(np.abs(queries).max(initial=0)), 1.0) * max(1, data.shape[1])
        self.exact_in_double = largest < 2**53
        self.best = np.full((len(queries), k), LEAST)
        self.best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(queries), LEAST) if floor is None else floor
        self.shrink, self.near, self.asked = shrink, *(x if shrink == 1 else x * shrink for x in (data, queries))
        self.q_norm = np.sqrt((self.asked**2).sum(1))
        self.scored = 0

    def worst(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.best[rows, -1], self.floor[rows])

    def to_reach(self, rows: np.ndarray) -> np.ndarray:
        return reach(self.worst(rows), self.shrink)

    @staticmethod
    def _up(bound):
        return bound + 1e-9 * np.abs(bound) + 1e-6

    def bound(self, a: Node, b: Node) -> float:
        return float(self._up(a.center @ b.center + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius))

    def run(self) -> None:
        if len(self.q) and len(self.x):
            self.visit(Node(self.asked, np.arange(len(self.q))), Node(self.near, np.arange(len(self.x))))

    def visit(self, a: Node, b: Node) -> None:
        if self.bound(a, b) < self.to_reach(a.points).min():
            return
        if a.children or a.crumbs is not None:
            for c in a.children:
                self.visit(c, b)
            if a.crumbs is not None:
                self.group(a.crumbs[2], b)
        else:
            self.group(a.points, b)

    def group(self, rows: np.ndarray, b: Node) -> None:
        """Some queries against a node: its children with the highest bounds first."""
        for lo in range(0, len(rows), 512):
            part = rows[lo : lo + 512]
            q, norm = self.asked[part], self.q_norm[part]
            if not b.children and b.crumbs is None:
                if (self._up(q @ b.center + norm * b.radius) >= self.to_reach(part)).any():
                    self.leaves(part, b.points)
                continue
            if b.crumbs is not None:
                centres, radius, points, child = b.crumbs
                near = (self._up(q @ self.near[centres].T + norm[:, None] * radius) >= self.to_reach(part)[:, None]).any(0)
                self.leaves(part, points[near[child]])
            if b.children:
                top = np.stack([self._up(q @ c.center + norm * c.radius) for c in b.children])
                for k in np.argsort(-top.max(1)):
                    keep = top[k] >= self.to_reach(part)
                    if keep.any():
                        self.group(part[keep], b.children[k])

    def leaves(self, rows: np.ndarray, points: np.ndarray) -> None:
        for j in range(0, len(points), 1024):
            cols = points[j : j + 1024]
            self.scored += len(rows) * len(cols)
            s = self.products(rows, cols)
            s[self.query_ids[rows][:, None] == self.ids[cols][None, :]] = LEAST
            hit = np.flatnonzero((s >= self.worst(rows)[:, None]).any(1))
            if not len(hit):
                continue
            some = rows[hit]
            scores = np.concatenate([self.best[some], s[hit]], 1)
            names = np.concatenate([self.best_ids[some], np.broadcast_to(self.ids[cols], (len(some), len(cols)))], 1)
            order = np.lexsort((names, -scores), axis=1)[:, : self.k]
            self.best[some], self.best_ids[some] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)

    def products(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        if self.exact_in_double:
            return (self.q[rows] @ self.x[cols].T).astype(np.int64)
        whole = np.vectorize(int, otypes=[object])
        s = whole(self.q[rows]) @ whole(self.x[cols]).T
        return np.clip(s, LEAST + 1, -LEAST).astype(np.int64)


class Pivots:
    """The top level: centres, and the covering radius of each."""

    def __init__(self, centres: np.ndarray):
        self.centres, self.radius, self.blocks = centres, np.zeros(len(centres)), np.ones(len(centres), np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = (x**2).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * x @ self.centres.T
        at = d.argmin(1)
        return at, np.sqrt(((x - self.centres[at]) ** 2).sum(1))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        return DualTree._up(q @ self.centres.T + np.sqrt((q**2).sum(1))[:, None] * self.radius)


def top_k(table: DataFrame, is_query, k: int = 5, scale: int = 256, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query, with floor(scale * x).

    table needs vec_id and embedding; is_query is a condition on vec_id. Null, empty, ragged (not of the usual length)
    vectors and those with null or non-finite components take no part, nor do rows with null vec_id. Rows that share
    a vec_id are each a candidate for others, and never for their own query. Fewer candidates than k: all. An empty table
    gives an empty result. Exact in double precision up to 2^53, beyond in whole numbers; scores stop at 64 bits, and
    scaled components at the largest double.
    candidates, queries: rows that one task holds of each.
    """
    spark = table.sparkSession
    work = Workspace(spark, "topk")
    base = work.write(valid(table, zero=True), "valid")
    n, largest = base.agg(F.count("*"), F.max(F.array_max(F.transform("embedding", F.abs)))).first()
    shrink = shrunk(largest or 0.0, scale)

    def quantised(t) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.nan_to_num(np.floor(scale * matrix(t.column("embedding"))))

    wanted = min(PIVOTS, -(-n // candidates))
    # A bounded sample by hash of vec_id.
    near = base.where(dealt(1 << 20, "vec_id") < max(1.0, min(1.0, 4 * wanted / max(1, n)) * (1 << 20))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, wanted)).toArrow()
    if not near.num_rows:
        near = base.orderBy("vec_id").limit(max(1, wanted)).toArrow()
    pivots = Pivots(np.unique(shrink * quantised(near), axis=0) if near.num_rows else np.zeros((1, 1)))
    place = spark.sparkContext.broadcast(plain(pivots))  # at most PIVOTS rows

    def assign(batches):
        pivots = rebuilt(Pivots, place.value)
        for batch in batches:
            at, away = pivots.nearest(shrink * quantised(batch)) if len(batch) else (np.empty(0, np.int64), np.empty(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), pa.array(away)], [*batch.schema.names, "pivot", "away"])

    placed = work.write(base.mapInArrow(assign, "vec_id long, embedding array<double>, pivot long, away double"), "placed")
    for r in placed.groupBy("pivot").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect():  # a row per pivot
        pivots.radius[r.pivot], pivots.blocks[r.pivot] = r.radius * (1 + 1e-9) + 1e-6, -(-r.n // candidates)
    full = spark.sparkContext.broadcast(plain(pivots))
    asked = work.write(queries_of(base, is_query), "queries")
    qb = max(1, -(-asked.count() // queries))
    blocks = F.element_at(F.array(*(F.lit(int(b)) for b in pivots.blocks)), (F.col("pivot") + 1).cast("int"))
    left = placed.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), blocks).cast("int"))
    left = left.select("pivot", "block", every(qb).alias("qb"), F.lit(False).alias("query"), "vec_id", "embedding", F.lit(None).cast("long").alias("floor"))

    def route(first: bool):
        def run(batches):
            pivots = rebuilt(Pivots, full.value)
            for batch in batches:
                q = shrink * quantised(batch)
                if not len(q):
                    continue
                bounds = pivots.bounds(q)
                best = bounds.argmax(1)
                if first:
                    who, to = np.arange(len(q)), best
                else:
                    who, to = np.nonzero(bounds >= reach(batch.column("floor").to_numpy(), shrink)[:, None])
                table = batch.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*table.columns, pa.array(to, pa.int64()), pa.array(to == best[who])], [*batch.schema.names, "pivot", "best"])

        return run

    def run(key, table):
        asked = np.array(table.column("query").to_numpy(), bool)
        a, b = table.filter(pa.array(~asked)), table.filter(pa.array(asked))
        ids = b.column("vec_id").to_numpy()
        tree = DualTree(quantised(a), a.column("vec_id").to_numpy(), quantised(b), ids, k, b.column("floor").to_numpy().astype(np.int64), shrink)
        if len(a):
            tree.run()
        who, at = np.nonzero(tree.best != LEAST)
        return pa.table({"query_id": pa.array(ids[who], pa.int64()), "vec_id": pa.array(tree.best_ids[who, at]), "score": pa.array(tree.best[who, at])})

    found = "query_id long, vec_id long, score long"
    routed = "vec_id long, embedding array<double>, floor long, pivot long, best boolean"

    def searched(rows: DataFrame) -> DataFrame:
        right = rows.select("pivot", "block", dealt(qb, "vec_id").alias("qb"), F.lit(True).alias("query"), "vec_id", "embedding", "floor")
        return left.unionByName(right).groupBy("pivot", "block", "qb").applyInArrow(run, found)

    start = asked.withColumn("floor", F.lit(LEAST)).mapInArrow(route(True), routed).withColumn("block", F.lit(0))
    one = work.write(ranked(searched(start), k), "first")
    floor = one.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    more = asked.join(floor, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(LEAST))).mapInArrow(route(False), routed)
    more = more.withColumn("block", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1))).where(~F.col("best") | (F.col("block") > 0))
    return ranked(one.drop("rank").unionByName(searched(more)), k)


def op3_cover_tree_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
