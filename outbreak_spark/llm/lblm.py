"""Scoring documents with a log-bilinear neural language model, trained with noise-contrastive estimation in numpy.

Every word of the corpus is a class of its own, in up to two factors. The head has the most frequent words of the
training documents, the end of a text, and GROUPS groups of all other words. A word of the rest has, by its hash, a group
and a leaf in the group; the number of leaves grows with the training vocabulary, so that a leaf has some tens of words,
which share it by their counts. The two tokens before give a context vector, elementwise products of their vectors with
a position's weights (words of the rest share vectors by hash). Its products with the output vectors, plus biases, are
scores, and softmaxes over the head and over the leaves of a group are the probabilities of each factor:
P(word) = P(group) P(leaf | group) share(word | leaf), which sums to one over all words.

Texts are tokenised once and written as flushes: a flush's distinct hashes, and per token a 32-bit index into them. All
later passes read that table, whose flush numbers are data: they don't depend on how it is read. Counts cover all
training documents: every flush sends each distinct word's hash and count once, and gets the word's total back. So does
the model: each of ROUNDS takes other flushes, until all were used once; each task trains on its own from the same
start and the parameters are averaged, in a tree, after each round (so they depend on how the table is dealt to tasks).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outbreak_spark.llm.common import SENT, SUMMARY, U64, Exchange, WordHashes, Workspace, flushes, plain, rebuilt, release, text_bytes

#: Head classes, of which the first GROUPS are those of the rest; dimensions; vectors that the rest shares as context.
CLASSES, GROUPS, DIMS, SHARED = 1088, 64, 32, 16
#: Noise samples of a batch for the head, and of a token for leaves.
NOISE, LEAF_NOISE, BATCH = 64, 2, 4096
ROUNDS = 2
#: Text bytes of a row of the token table, and rows that are scored together.
FLUSH, TOGETHER = 2 << 20, 4
END, WORD, BEGIN = GROUPS, GROUPS + 1, CLASSES
END_HASH = U64(0x1F3D5B79A2C4E680)
#: Leaves in the finest division that is counted; the model's leaves are unions of them.
FINEST = 1 << 18


def token_hashes(texts: list[bytes], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and its end, and the number of each text's tokens."""
    parts = []
    for t in texts:
        parts += [cache.of(t.lower().split()), np.array([END_HASH], U64)]
    lens = np.array([len(parts[k]) + 1 for k in range(0, len(parts), 2)], np.int64)
    return np.concatenate(parts) if parts else np.empty(0, U64), lens


def leaves_for(distinct: int) -> int:
    """Leaves of a group, a power of two that grows with the square root of the vocabulary."""
    return 1 << int(np.clip(np.log2(max(1, distinct) ** 0.5 / 8), 2, np.log2(FINEST // GROUPS)))


class Vocabulary:
    """Classes of words by hash; counts and sizes of the corpus.

    hashes, counts: of the head's words. leaf, leaf_total, leaf_distinct: counts of all words by finest leaf.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, ends: int, leaf: np.ndarray, leaf_total: np.ndarray, leaf_distinct: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.classes = hashes[order], (np.arange(len(hashes)) + WORD)[order]
        self.total, self.distinct = total, distinct
        self.leaves = GROUPS * leaves_for(distinct)
        own = (hashes % U64(self.leaves)).astype(np.int64)
        size = lambda at, n: np.bincount(at, n, self.leaves).astype(np.int64)
        self.leaf_total = size(leaf % self.leaves, leaf_total) - size(own, counts)
        self.leaf_distinct = size(leaf % self.leaves, leaf_distinct) - size(own, np.ones(len(own)))
        mass = self.leaf_total.reshape(-1, GROUPS) + 0.1
        self.leaf_share = mass / mass.sum(0)
        share = np.r_[mass.sum(0), ends + 0.1, counts + 0.1, np.full(CLASSES - WORD - len(counts), 0.1)]
        self.share = share / share.sum()

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = (hashes % U64(GROUPS)).astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            out[hit] = self.classes[at[hit]]
        out[hashes == END_HASH] = END
        return out

    def leaf_of(self, hashes: np.ndarray) -> np.ndarray:
        """leaf % GROUPS is the group."""
        return (hashes % U64(self.leaves)).astype(np.int64)

    def in_leaf(self, leaf: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its leaf; what no training text has, has a share too."""
        return np.log10((counts + 0.1) / (self.leaf_total[leaf] + 0.1 * (self.leaf_distinct[leaf] + 1)))


class LogBilinear:
    def __init__(self, words: Vocabulary, seed: int = 11):
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        logs = lambda x: np.log(x).astype(np.float32)
        self.words, self.leaves = words, words.leaves
        self.params = [small(CLASSES + 1, DIMS), 1 + small(2, DIMS), small(CLASSES, DIMS), logs(words.share), small(self.leaves, DIMS), logs(words.leaf_share).ravel()]
        self.seen = [np.full(len(p), 1e-2, np.float32) for p in self.params]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params])

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for k, p in enumerate(self.params):
            self.params[k] = flat[at : at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
        return self

    def _step(self, k: int, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
        """Adagrad by row, given a gradient for each place in `rows`. Short numbers have a radix sort in numpy."""
        if len(self.params[k]) < 1 << 15:
            rows = rows.astype(np.int16)
        order = np.argsort(rows, kind="stable")
        s = rows[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        grad, s = np.add.reduceat(grad[order], first, axis=0), s[first]
        wide = grad.ndim > 1
        total = self.seen[k][s] + (np.einsum("ij,ij->i", grad, grad) / np.float32(DIMS) if wide else grad * grad)
        self.seen[k][s] = total
        step = np.float32(rate) / np.sqrt(total)
        self.params[k][s] -= grad * (step[:, None] if wide else step)

    def train(self, contexts: np.ndarray, targets: np.ndarray, leaves: np.ndarray, rng: np.random.Generator, rate: float = 0.1) -> None:
        """One pass of noise-contrastive estimation, whose Adagrad sums go on from call to call. Contexts come in random
        order, each with all its targets, so that what depends on the context alone is done once; noise samples are shared
        by a batch. leaves: those of the targets that are of the rest, against noise from their own group."""
        words, vectors, weights, out, bias, leaf_out, leaf_bias = self.words, *self.params
        noise_log, draws = np.log(NOISE * words.share).astype(np.float32), np.cumsum(words.share)
        per_group = self.leaves // GROUPS
        leaf_log = np.float32(np.log(LEAF_NOISE / per_group))
        _, at = np.unique(contexts[:, 0].astype(np.int64) * (CLASSES + 1) + contexts[:, 1], return_inverse=True)
        turn = rng.permutation(int(at.max(initial=-1)) + 1)[at]
        order = np.argsort(turn, kind="stable")
        turn, targets, leaves = turn[order], targets[order], leaves[order]
        for i in range(0, len(targets), BATCH):
            w, t = targets[i : i + BATCH], turn[i : i + BATCH]
            n, scale = len(w), np.float32(8 / len(w))
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            times = np.diff(np.r_[first, n]).astype(np.float32)
            c = contexts[order[i + first]]
            a, b = vectors[c[:, 0]], vectors[c[:, 1]]
            q = a * weights[0] + b * weights[1]
            own = np.repeat(q, times.astype(np.int64), axis=0)
            noise = np.minimum(np.searchsorted(draws, rng.random(NOISE)), CLASSES - 1)
            near, far = out[w], out[noise]
            g_real = -1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", own, near) + (bias - noise_log)[w], -30, 30)))
            g_fake = times[:, None] / (1 + np.exp(-np.clip(q @ far.T + (bias - noise_log)[noise], -30, 30)))
            near *= g_real[:, None]
            rest = np.flatnonzero(w < GROUPS)
            if len(rest):
                leaf, mine = leaves[i : i + BATCH][rest], own[rest]
                rows = np.concatenate([leaf[:, None], rng.integers(0, per_group, (len(rest), LEAF_NOISE)) * GROUPS + (leaf % GROUPS)[:, None]], 1).T
                grads = []
                for k, row in enumerate(rows):
                    some = leaf_out[row]
                    g = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", mine, some) + leaf_bias[row] - leaf_log, -30, 30))) - np.float32(k == 0)
                    near[rest] += g[:, None] * some
                    grads.append(g)
                g = np.concatenate(grads) * scale
                self._step(4, rows.ravel(), np.tile(mine, (LEAF_NOISE + 1, 1)) * g[:, None], rate)
                self._step(5, rows.ravel(), g, rate)
            g_q = np.add.reduceat(near, first, axis=0) + g_fake @ far
            own *= g_real[:, None]
            rows = np.concatenate([w, noise])
            self._step(2, rows, np.concatenate([own, g_fake.T @ q]) * scale, rate)
            self._step(3, rows, np.concatenate([g_real, g_fake.sum(0)]) * scale, rate)
            self._step(0, c.T.ravel(), np.concatenate([g_q * weights[0], g_q * weights[1]]) * scale, rate)
            self._step(1, np.arange(2), np.stack([np.einsum("ij,ij->j", g_q, a), np.einsum("ij,ij->j", g_q, b)]) / n, rate)

    def contexts(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of contexts (the class before last, the last)."""
        vectors, weights = self.params[:2]
        return vectors[codes[:, 0]] * weights[0] + vectors[codes[:, 1]] * weights[1]

    @staticmethod
    def softmax_logs(s: np.ndarray) -> np.ndarray:
        s = s - s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, dtype=np.float64))[:, None].astype(np.float32)

    def log_probabilities(self, contexts: np.ndarray) -> np.ndarray:
        """Natural logs for all head classes, a row per context."""
        return self.softmax_logs(self.contexts(contexts) @ self.params[2].T + self.params[3])

    def leaf_logs(self, contexts: np.ndarray) -> np.ndarray:
        """Natural logs for all leaves, given their group, a row per context."""
        s = (self.contexts(contexts) @ self.params[4].T + self.params[5]).reshape(len(contexts), -1, GROUPS).transpose(0, 2, 1)
        s = self.softmax_logs(s.reshape(len(contexts) * GROUPS, -1)).reshape(len(contexts), GROUPS, -1)
        return s.transpose(0, 2, 1).reshape(len(contexts), -1)

    def token_logs(self, contexts: np.ndarray, targets: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Of each target in its context, to its leaf if it is one of the rest. The head's probabilities of each distinct
        context are computed once, in blocks of one matrix product; leaves by group."""
        width = CLASSES + 1
        code = contexts[:, 0].astype(np.int32) * np.int32(width) + contexts[:, 1]
        order = np.argsort(code, kind="stable")
        s = code[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
        ends, logs = np.r_[first[1:], len(s)], np.empty(len(s))
        out, bias, leaf_out, leaf_bias = self.params[2:]
        for i in range(0, len(first), 2048):
            block = s[first[i : i + 2048]]
            q = self.contexts(np.stack([block // width, block % width], 1))
            lo, hi = first[i], ends[min(i + 2048, len(first)) - 1]
            row, at = np.repeat(np.arange(len(block), dtype=np.int16), ends[i : i + 2048] - first[i : i + 2048]), order[lo:hi]
            logs[at] = self.softmax_logs(q @ out.T + bias)[row, targets[at]]
            rest = targets[at] < GROUPS
            row, at = row[rest], at[rest]
            if not len(at):
                continue
            group = targets[at]
            by = np.argsort(group.astype(np.int8), kind="stable")
            cut = np.searchsorted(group[by], np.arange(GROUPS + 1))
            for g in np.flatnonzero(np.diff(cut)):
                m = by[cut[g] : cut[g + 1]]
                table = self.softmax_logs(q[row[m]] @ leaf_out[g::GROUPS].T + leaf_bias[g::GROUPS])
                logs[at[m]] += table[np.arange(len(m)), leaves[at[m]] // GROUPS]
        return logs


def contexts_of(classes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The two tokens before each token, as classes; groups of the rest share some. Before a text stands BEGIN."""
    classes = np.where(classes < GROUPS, classes % SHARED, classes).astype(np.int16)
    starts = np.cumsum(lens) - lens
    out = np.empty((len(classes), 2), np.int16)
    out[1:, 1] = classes[:-1]
    out[starts, 1] = BEGIN
    out[1:, 0] = out[:-1, 1]
    out[starts, 0] = BEGIN
    return out


def summary(words: np.ndarray, sums: np.ndarray) -> tuple[bytes, ...]:
    """Of a bucket's words: its most frequent ones and their counts; totals and distinct words by finest leaf; sizes."""
    sums = sums.astype(np.int64)
    word = (words != END_HASH) & (sums > 0)
    w, n = words[word], sums[word]
    top = np.lexsort((w, -n))[:CLASSES]
    leaf, at = np.unique((w % U64(FINEST)).astype("<i8"), return_inverse=True)
    by = np.concatenate([leaf, np.bincount(at, n, len(leaf)).astype("<i8"), np.bincount(at, minlength=len(leaf)).astype("<i8")])
    ends = int(sums[words == END_HASH].sum())
    return np.array([sums.sum(), (sums > 0).sum(), ends], "<i8").tobytes(), w[top].tobytes(), n[top].astype("<i8").tobytes(), by.astype("<i8").tobytes()


TOKENS = "flush long, doc_ids binary, missing binary, training binary, lens binary, words binary, at binary"


def _read(batch):
    """(flush, training mask by document, lens, distinct hashes, index of each token) of the rows of a token table."""
    for flush, training, lens, words, at in zip(*(batch.column(c).to_pylist() for c in ("flush", "training", "lens", "words", "at")), strict=True):
        yield flush, np.frombuffer(training, bool), np.frombuffer(lens, "<i8"), np.frombuffer(words, "<u8"), np.frombuffer(at, "<u4")


def score(docs: DataFrame, is_training, most_buckets: int = 512) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score of each document.

    docs needs doc_id and text; other columns are ignored; is_training is a condition on doc_id. base_score: add-0.1
    unigram log10 probability; score: the model's. Null and empty texts are one end token. Null and repeated doc_ids
    are kept, each row a document. Without training documents the base is uniform and so is the model. An empty table
    gives an empty result. most_buckets: see Exchange.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "lm")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(is_training, F.lit(False)).alias("training"), text)

    def code(batches):
        cache = WordHashes()
        for flush, (names, training, texts) in flushes(batches, ["doc_id", "training", "text"], FLUSH):
            h, lens = token_hashes(texts, cache)
            words, at = np.unique(h, return_inverse=True)
            missing = np.array([x is None for x in names])
            name = np.array([0 if x is None else x for x in names], "<i8")
            yield pa.RecordBatch.from_pydict({"flush": pa.array([flush], pa.int64()), **{k: pa.array([x.tobytes()], pa.binary()) for k, x in (("doc_ids", name), ("missing", missing), ("training", np.array(training, bool)), ("lens", lens), ("words", words), ("at", at.astype("<u4")))}})

    tokens = work.write(rows.mapInArrow(code, TOKENS), "tokens")
    exchange = Exchange(text_bytes(docs), most=most_buckets, totals=True, summary=summary)

    def counts(batches):
        for batch in batches:
            for flush, training, lens, words, at in _read(batch):
                n = np.bincount(at, np.repeat(training.astype(float), lens), len(words)).astype("<u8")
                yield exchange.send(flush, words, np.arange(len(words)), (), n)

    answers = exchange.answered(tokens.select("flush", "training", "lens", "words", "at").mapInArrow(counts, SENT))
    totals = work.write(answers, "totals")
    stats = totals.where(F.col("bucket") == SUMMARY)

    def tops(batches):
        for batch in batches:
            for h, n in zip(batch.column("b").to_pylist(), batch.column("c").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"h": pa.array(np.frombuffer(h, "<i8")), "n": pa.array(np.frombuffer(n, "<i8"))})

    def leaves(batches):
        for batch in batches:
            for by in batch.column("d").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.frombuffer(by, "<i8").reshape(3, -1)], ["leaf", "n", "v"])

    def sizes(batches):
        for batch in batches:
            for a in batch.column("a").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.frombuffer(a, "<i8").reshape(3, 1)], ["n", "v", "ends"])

    size = stats.select("a").mapInArrow(sizes, "n long, v long, ends long").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("ends").alias("ends")).first()
    best = stats.select("b", "c").mapInArrow(tops, "h long, n long").orderBy(F.desc("n"), "h").limit(CLASSES - WORD).toArrow()
    # At most FINEST rows.
    leaf = stats.select("d").mapInArrow(leaves, "leaf long, n long, v long").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
    by_leaf = [leaf.column(c).to_numpy() for c in ("leaf", "n", "v")]
    vocabulary = Vocabulary(best.column("h").to_numpy().view(U64), best.column("n").to_numpy(), size.n or 0, size.v or 0, size.ends or 0, *by_leaf)
    model = LogBilinear(vocabulary)
    shared = spark.sparkContext.broadcast(plain(vocabulary))  # bounded: CLASSES words and FINEST leaves
    for step in range(ROUNDS if size.n else 0):
        start = spark.sparkContext.broadcast(model.flat())

        def local(batches, start=start, step=step):
            known, part = rebuilt(Vocabulary, shared.value), TaskContext.get().partitionId()
            own, seen = LogBilinear(known).load(start.value), 0
            for batch in batches:
                for flush, training, lens, words, at in _read(batch):
                    keep = np.repeat(training, lens)
                    at, lens = at[keep], lens[training]
                    if not len(at):
                        continue
                    c, leaf = known.of(words)[at], known.leaf_of(words)[at]
                    own.train(contexts_of(c, lens), c, leaf, np.random.default_rng([step, flush]))
                    seen += len(c)
            if seen:
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "n": pa.array([float(seen)]), "p": pa.array([own.flat().astype("<f4").tobytes()], pa.binary())})
            release()

        def average(key, table):
            n = np.array(table.column("n").to_pylist())
            p = sum(x * np.frombuffer(b, "<f4").astype(float) for x, b in zip(n, table.column("p").to_pylist(), strict=True)) / n.sum()
            return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([float(n.sum())]), "p": pa.array([p.astype("<f4").tobytes()], pa.binary())})

        schema = "part long, n double, p binary"
        part = tokens.where(F.pmod("flush", F.lit(ROUNDS)) == step).select("flush", "training", "lens", "words", "at")
        level = work.write(part.mapInArrow(local, schema), f"params{step}")
        most, k = level.agg(F.max("part")).first()[0], 0
        while most is not None and most >= 16:
            most, k = most // 16, k + 1
            level = work.write(level.withColumn("part", F.floor(F.col("part") / 16)).groupBy("part").applyInArrow(average, schema), f"params{step}-{k}")
        got = level.toArrow()  # at most 16 rows
        if got.num_rows:  # a small table may have none in a round
            model.load(np.frombuffer(average([pa.scalar(0)], got).column("p")[0].as_py(), "<f4"))
    trained = spark.sparkContext.broadcast(model.flat())

    def scored(left, right):
        known = rebuilt(Vocabulary, shared.value)
        own = LogBilinear(known).load(trained.value)
        given: dict[int, list] = {}
        for flush, a, d in zip(*(right.column(x).to_pylist() for x in ("flush", "a", "d")), strict=True):
            given.setdefault(flush, []).append((np.frombuffer(a, "<u4"), np.frombuffer(d, "<u8")))
        parts, by_text = [], []
        for flush, _, lens, words, at in _read(left):
            c = np.zeros(len(words), np.int64)
            for where, n in given.pop(flush, ()):
                c[where] = n
            cls, leaf = known.of(words), known.leaf_of(words)
            base = np.log10((c + 0.1) / (known.total + 0.1 * (known.distinct + 1)))
            inner = np.where(cls < GROUPS, known.in_leaf(leaf, c), 0.0)
            starts = np.cumsum(lens) - lens
            by_text.append([np.add.reduceat(x[at], starts) for x in ((c > 0).astype(np.int32), base, inner)])
            parts.append((lens, cls.astype(np.int16)[at], leaf.astype(np.int32)[at]))
        lens, cls, leaf = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        seen, base, inner = (np.concatenate(x) for x in zip(*by_text, strict=True))
        score = np.add.reduceat(own.token_logs(contexts_of(cls, lens), cls, leaf), np.cumsum(lens) - lens) / np.log(10) + inner
        release()
        name, missing, training = (np.frombuffer(b"".join(left.column(x).to_pylist()), t) for x, t in (("doc_ids", "<i8"), ("missing", bool), ("training", bool)))
        out = [pa.array(name, pa.int64(), mask=missing), pa.array(training), pa.array(lens), pa.array(seen.astype(np.int64)), pa.array(np.full(len(lens), known.total)), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(out, ["doc_id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    together = F.floor(F.col("flush") / TOGETHER).cast("long").alias("together")
    back = totals.where(F.col("bucket") != SUMMARY).where("d is not null").select(together, "flush", "a", "d").groupBy("together")
    return tokens.select(together, "*").groupBy("together").cogroup(back).applyInArrow(scored, "doc_id long, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_log_bilinear_lm(spark, sf_dir: str) -> DataFrame:
    from outbreak_spark.llm.langid import held_out

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, ~held_out(10) & F.col("doc_id").isNotNull())
    return out.select("doc_id", held_out(10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
