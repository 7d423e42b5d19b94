"""Approximate nearest neighbours by inner product with score-aware (anisotropic) product quantisation.

An error of a vector's approximation along the vector changes the inner products that matter, those with queries near
it, more than an error across it. So codes and codebooks minimise |r|^2 + (eta - 1) <r, x/|x|>^2 of the residual r,
eta > 1: codes by coordinate descent over the subspaces, codebooks by their normal equations. Each subspace of two
dimensions has 16 centres, 4 bits; a query scans codes by tables of its products with the centres (two codes, one byte,
at a time). Each task scans the codes of a block of rows, scores those rows exactly, on their original vectors, that may
be among a query's best by what codes are seen to be off, and hands on the best of its block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outbreak_spark.llm.common import Workspace
from outbreak_spark.llm.vectors import dealt, every, matrix, queries_of, ranked, valid

CENTRES = 16
#: Codes of a block of candidates, and queries, that one task holds.
CANDIDATES, QUERIES = 1 << 16, 1 << 14
#: Rows of a block that show how far codes are off; how many standard deviations count; what float32 sums lose.
SAMPLE, DEVIATIONS, ROUNDING = 1024, 3.5, 1e-5


class Codebook:
    def __init__(self, sample: np.ndarray, threshold: float = 0.2, rounds: int = 6, seed: int = 5):
        """sample: rows to fit on. threshold: the cosine that a query near a vector has, which sets eta."""
        self.dims = sample.shape[1]
        self.parts = -(-self.dims // 4) * 2  # an even number of two-dimensional subspaces
        self.eta = max(1.0, (self.dims - 1) * threshold**2 / (1 - threshold**2))
        x = self._split(sample)
        rng = np.random.default_rng(seed)
        pick = rng.permutation(len(x))[:CENTRES]
        self.centres = np.stack([x[np.resize(pick, CENTRES), m] for m in range(self.parts)]) + rng.normal(0, 1e-6, (self.parts, CENTRES, 2))
        for _ in range(rounds):
            codes = self.encode(sample, sweeps=1)
            self._fit(x, self._unit(sample), codes)

    def _split(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, 2 * self.parts - self.dims))).reshape(len(x), self.parts, 2)

    def _unit(self, x: np.ndarray) -> np.ndarray:
        return self._split(x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-300))

    def encode(self, vectors: np.ndarray, sweeps: int = 2) -> np.ndarray:
        x, u = self._split(vectors), self._unit(vectors)
        n = len(x)
        codes = np.empty((n, self.parts), np.uint8)
        along = np.empty((n, self.parts))
        for m in range(self.parts):
            r = x[:, m, None, :] - self.centres[m]
            codes[:, m] = (r**2).sum(2).argmin(1)
            along[:, m] = ((x[:, m] - self.centres[m][codes[:, m]]) * u[:, m]).sum(1)
        total = along.sum(1)
        for _ in range(sweeps):
            for m in range(self.parts):
                r = x[:, m, None, :] - self.centres[m]
                own = (r * u[:, m, None, :]).sum(2)
                cost = (r**2).sum(2) + (self.eta - 1) * ((total - along[:, m])[:, None] + own) ** 2
                codes[:, m] = cost.argmin(1)
                new = own[np.arange(n), codes[:, m]]
                total += new - along[:, m]
                along[:, m] = new
        return codes

    def _fit(self, x: np.ndarray, u: np.ndarray, codes: np.ndarray) -> None:
        near = np.stack([self.centres[m][codes[:, m]] for m in range(self.parts)], 1)
        along = ((x - near) * u).sum(2)
        total = along.sum(1)
        for m in range(self.parts):
            rest = total - along[:, m] + (x[:, m] * u[:, m]).sum(1)
            for c in range(CENTRES):
                own = codes[:, m] == c
                if own.any():
                    v = u[own, m]
                    left = own.sum() * np.eye(2) + (self.eta - 1) * v.T @ v
                    self.centres[m, c] = np.linalg.solve(left, x[own, m].sum(0) + (self.eta - 1) * rest[own] @ v)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        return codes[:, 0::2] | (codes[:, 1::2] << 4)

    def tables(self, queries: np.ndarray, scale: float = 1.0) -> np.ndarray:
        """(bytes of a code, 256, queries): what each byte adds to each query's score, times scale."""
        one = np.einsum("qmd,mcd->mcq", self._split(queries), self.centres * scale)
        low, high = one[0::2], one[1::2]
        return (high[:, :, None, :] + low[:, None, :, :]).reshape(len(low), 256, len(queries)).astype(np.float32)


def index(vectors: DataFrame, sample_rows: int = 8192) -> tuple[DataFrame, Codebook | None]:
    """Every row with its code. The codebook is fitted on about sample_rows rows at most, chosen by hash of vec_id."""
    n = vectors.count()
    if not n:
        return vectors.withColumn("code", F.lit(None).cast("binary")), None
    share = min(1.0, sample_rows / n)
    chosen = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20))))
    sample = chosen.select("vec_id", "embedding").toArrow().sort_by("vec_id")
    if not sample.num_rows:  # a few rows may all miss the share
        sample = vectors.limit(CENTRES).toArrow()
    book = Codebook(matrix(sample.column("embedding")))

    def encode(batches):
        for batch in batches:
            code = book.pack(book.encode(matrix(batch.column("embedding")))) if len(batch) else np.empty((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in code], pa.binary())], [*batch.schema.names, "code"])

    return vectors.mapInArrow(encode, "vec_id long, embedding array<double>, code binary"), book


class Block:
    """Coded rows that one task holds, for searches among them.

    A code's score is scaled by |x|^2 / <x, its approximation>, so that it is right for a query along x, whatever the
    row's length; what is left over, rest, is at right angles to x. A row counts for a query if its score may be off by so
    much of |rest| that it belongs to the best: by the largest share that the query's other rows show, those of a sample
    and the best by codes, and by DEVIATIONS times the root of the mean square of the sample. So rows that codes don't tell
    apart, as near copies, or don't fit, as rows unlike the codebook's sample, are all scored exactly.
    """

    def __init__(self, book: Codebook, codes: np.ndarray, x: np.ndarray, ids: np.ndarray):
        self.book, self.codes, self.ids, self.x = book, codes, ids, x
        self.unit = float(np.abs(x).max(initial=0.0)) or 1.0  # so that products stay finite
        both = np.stack([codes & 15, codes >> 4], 2).reshape(len(x), -1)
        share, rest, near = np.zeros(len(x), np.float32), np.empty(len(x), np.float32), book.centres / self.unit
        picked = np.linspace(0, len(x) - 1, min(SAMPLE, len(x))).astype(int)
        self.sample = np.zeros((len(picked), x.shape[1]))
        for i in range(0, len(x), 4096):
            own = x[i : i + 4096] / self.unit
            like = near[np.arange(book.parts), both[i : i + 4096]].reshape(len(own), -1)[:, : x.shape[1]]
            square, product = (own**2).sum(1), (own * like).sum(1)
            fits = product > 0.1 * np.sqrt(square * (like**2).sum(1))
            factor = np.where(fits, square / np.where(fits, product, 1.0), 0.0)
            left = own - factor[:, None] * like
            share[i : i + 4096], rest[i : i + 4096] = factor, np.where(fits, np.sqrt((left**2).sum(1)), np.inf)
            here = (picked >= i) & (picked < i + 4096)
            length = np.sqrt((left**2).sum(1, keepdims=True))
            self.sample[here] = (left / np.maximum(length, 1e-300))[picked[here] - i] * fits[picked[here] - i, None]
        self.share, self.rest = share, rest

    def best(self, queries: np.ndarray, query_ids: np.ndarray, k: int, least: int):
        """For each query the places of its k best rows and their scores; `least` rows at least are scored exactly."""
        top = max(k, least) + 1
        for i in range(0, len(queries), 64):
            some = queries[i : i + 64]
            length = np.maximum(np.abs(some).max(1, keepdims=True), 1e-300)
            q = some / length
            tables = self.book.tables(q, 1 / self.unit)
            scores = np.zeros((len(self.x), tables.shape[2]), np.float32)
            for m in range(self.codes.shape[1]):
                scores += tables[m][self.codes[:, m]]
            scores = np.ascontiguousarray((scores * self.share[:, None]).T)
            off = DEVIATIONS * np.sqrt(((q @ self.sample.T) ** 2).mean(1))
            for r, near in enumerate(scores):
                yield self._best_of(some[r], q[r], near, off[r], self.ids != query_ids[i + r], k, top)

    def _best_of(self, query, q, near, off, others, k: int, top: int):
        if len(near) > top:
            first = np.argpartition(near, len(near) - top)[len(near) - top :]
            first = first[others[first]]
            exact = (self.x[first] / self.unit) @ q
            rest = self.rest[first]
            fits = np.isfinite(rest) & (rest > 1e-6)
            shown = (exact - near[first])[fits] / rest[fits]
            off = max(off, float(np.abs(shown).max(initial=0.0)))
            reach = np.partition(exact, len(exact) - k)[len(exact) - k] if len(exact) >= k else -np.inf
            rest = np.minimum(self.rest, 1e30)
            chosen = near + (off * rest + ROUNDING * np.abs(q).sum()) >= reach
            chosen[first] = True
            chosen = np.flatnonzero(chosen & others)
        else:
            chosen = np.flatnonzero(others)
        score = np.empty(len(chosen))
        for j in range(0, len(chosen), 1 << 14):
            score[j : j + (1 << 14)] = (self.x[chosen[j : j + (1 << 14)]] * query).sum(1)
        order = np.lexsort((self.ids[chosen], -score))[:k]
        return chosen[order], score[order]


def nearest(table: DataFrame, is_query, k: int = 20, rerank: int = 200, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: about the k largest inner products of each query, scored in double precision.

    table needs vec_id and embedding; is_query is a condition on vec_id. rerank: how many candidates of a query each block
    scores exactly at least; more where codes leave it open which rows are the best. Null, empty, zero and ragged vectors,
    those with null or non-finite components and rows with null vec_id take no part. Rows that share a vec_id are each a
    candidate for others, and never for their own query. An empty table gives an empty result. candidates, queries: rows
    that one task holds of each, fewer if they have more than 64 components.
    """
    work = Workspace(table.sparkSession, "ann")
    base = work.write(valid(table, zero=False), "valid")
    coded, book = index(base)
    # A row's number, as written, deals rows of one vec_id out.
    coded = work.write(coded.withColumn("row", F.monotonically_increasing_id()), "coded")
    asked = work.write(queries_of(coded.select("vec_id", "embedding"), is_query), "queries")
    n, nq = coded.count(), asked.count()
    wide = max(1, (book.dims if book else 1) // 64)
    candidates, queries = max(1, candidates // wide), max(1, queries // wide)
    spread = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cb, qb = max(1, -(-n // candidates), min(spread, -(-n // 16384))), max(1, -(-nq // queries))
    left = coded.select(dealt(cb, "row").alias("cb"), every(qb).alias("qb"), "vec_id", "code", "embedding")
    right = asked.select(every(cb).alias("cb"), dealt(qb, "vec_id").alias("qb"), "vec_id", F.lit(None).cast("binary").alias("code"), "embedding")

    def scan(key, table):
        is_code = table.column("code").is_valid()
        a, b = table.filter(is_code), table.filter(pc.invert(is_code))
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(a) and len(b):
            codes = np.frombuffer(b"".join(a.column("code").to_pylist()), np.uint8).reshape(len(a), -1)
            ids, query_ids = (t.column("vec_id").to_numpy() for t in (a, b))
            block = Block(book, codes, matrix(a.column("embedding")), ids)
            for who, (at, score) in zip(query_ids, block.best(matrix(b.column("embedding")), query_ids, k, rerank), strict=True):
                out.append((np.full(len(at), who), ids[at], score))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    found = left.unionByName(right).groupBy("cb", "qb").applyInArrow(scan, "query_id long, vec_id long, score double")
    return ranked(found, k)


def op8_anisotropic_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
