"""Language identification by interpolated Kneser-Ney character models.

One model of order 5 per language, over the letters of lower-cased words with a space before and after. All models
share their tables: for each order, the hashes of the n-grams of any language, sorted, with a row of probabilities,
one per language, already interpolated with the lower orders; and likewise for contexts, with the weights of the lower
order. A lookup is a binary search; a word's sum is kept, so each distinct word is scored once per task.
A document goes to the language of lowest cross-entropy per letter. It is rejected if that is nearer to the
cross-entropy of the same kind of texts with their letters shuffled than to theirs as they are (by a calibrated share),
and well above nearly all of theirs.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outbreak_spark.llm.common import U64, fresh, mix, plain, rebuilt, release, sliced

ORDER = 5
LETTERS = re.compile(r"[^\W\d_]+")  # and numbers such as one half, which aren't decimal digits: taken out below
PAD = " "
NONE = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters, that is of characters of Unicode's categories L."""
    words = LETTERS.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    return [x for w in words for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def _hash(points: np.ndarray) -> np.ndarray:
    """Hashes of rows of code points."""
    h = np.full(len(points), points.shape[1] if points.ndim > 1 else 0, U64)
    for k in range(points.shape[1]):
        h = mix(h, points[:, k].astype(U64))
    return h


class Table:
    """A sorted hash array with a row of values for each hash."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.rows = hashes[order], rows[order].astype(np.float32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


class KneserNey:
    """grams: per language a mapping of ORDER-letter strings to counts."""

    def __init__(self, grams: dict[str, dict[str, int]]):
        self.languages = sorted(grams)
        n = len(self.languages)
        counts = []
        for lang in self.languages:
            own = sorted(grams[lang].items())
            points = np.array([g for g, _ in own], f"<U{ORDER}").view(np.uint32).reshape(-1, ORDER)
            counts.append((points, np.array([c for _, c in own], float)))
        alphabet = {p for points, _ in counts for p in np.unique(points[:, -1])}
        self.uniform = 1.0 / (len(alphabet) + 1)
        self.grams, self.contexts = [], []
        for k in range(1, ORDER + 1):
            own = []
            for points, c in counts:
                if k < ORDER:  # continuation counts: distinct letters before
                    kinds = np.unique(points[:, ORDER - k - 1 :], axis=0)
                    points, c = np.unique(kinds[:, 1:], axis=0, return_counts=True)
                own.append((points, c.astype(float)))
            union = np.unique(np.concatenate([p for p, _ in own]), axis=0)
            h, where = _hash(union), {}
            order = np.argsort(h)
            ctx_union = np.unique(union[:, :-1], axis=0) if k > 1 else np.zeros((1, 0), np.uint32)
            ctx_hash = _hash(ctx_union)
            ctx_order = np.argsort(ctx_hash)
            ctx_at = ctx_order[np.searchsorted(ctx_hash[ctx_order], _hash(union[:, :-1]))]
            discounted, weight = np.zeros((len(union), n)), np.ones((len(ctx_union), n))
            for lang, (points, c) in enumerate(own):
                at = order[np.searchsorted(h[order], _hash(points))]
                ones, twos = (c == 1).sum(), (c == 2).sum()
                d = ones / (ones + 2 * twos) if ones and twos else 0.5
                total = np.bincount(ctx_at[at], c, len(ctx_union))
                kinds = np.bincount(ctx_at[at], minlength=len(ctx_union))
                seen = total > 0
                weight[seen, lang] = d * kinds[seen] / total[seen]
                discounted[at, lang] = np.maximum(c - d, 0) / total[ctx_at[at]]
            lower = self.probabilities(union[:, 1:], k - 1)
            del where
            self.grams.append(Table(h, discounted + weight[ctx_at] * lower))
            self.contexts.append(Table(ctx_hash, weight))

    def plain(self) -> dict:
        """Attributes without classes of this package: see common.plain."""
        return plain(self) | {name: [plain(t) for t in getattr(self, name)] for name in ("grams", "contexts")}

    @classmethod
    def rebuilt(cls, attributes: dict) -> KneserNey:
        return rebuilt(cls, attributes | {name: [rebuilt(Table, t) for t in attributes[name]] for name in ("grams", "contexts")})

    def probabilities(self, points: np.ndarray, k: int) -> np.ndarray:
        """Of the last of each k letters after the others, a column per language."""
        n = len(self.languages)
        if not k:
            return np.full((len(points), n), self.uniform)
        at, found = self.grams[k - 1].find(_hash(points))
        out = np.empty((len(points), n))
        out[found] = self.grams[k - 1].rows[at[found]]
        if not found.all():
            rest = points[~found]
            ctx, known = self.contexts[k - 1].find(_hash(rest[:, :-1]))
            weight = np.where(known[:, None], self.contexts[k - 1].rows[ctx], 1.0)
            out[~found] = weight * self.probabilities(rest[:, 1:], k - 1)
        return out

    def score(self, words: list[str]) -> np.ndarray:
        """Per word: the log-probability by each language, and the number of letters scored (its end included)."""
        lens = np.array([len(w) for w in words], np.int64)
        text = np.frombuffer(((PAD * (ORDER - 1)).join(["", *words, ""])).encode("utf-32-le"), "<u4")
        # Each word has ORDER - 1 pads before it; the first pad after it is its end.
        starts = np.cumsum(lens + ORDER - 1) - lens
        first = np.repeat(starts - (ORDER - 1), lens + 1)
        inner = np.arange((lens + 1).sum()) - np.repeat(np.cumsum(lens + 1) - (lens + 1), lens + 1)
        rows = text[(first + inner)[:, None] + np.arange(ORDER)]
        logs = np.log(self.probabilities(rows, ORDER))
        ends = np.r_[0, np.cumsum(lens + 1)[:-1]]
        return np.c_[np.add.reduceat(logs, ends, axis=0), lens + 1] if len(words) else np.empty((0, len(self.languages) + 1))


class Scorer:
    """Cross-entropies of texts; each distinct word is scored once, so many new ones at a time."""

    MOST, AT_ONCE = 150_000, 4096

    def __init__(self, model: KneserNey):
        self.model, self.known = model, {}
        self.rows = np.empty((0, len(model.languages) + 1))

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Per text the sum of log-probabilities by language, and the number of letters."""
        if len(self.known) > self.MOST:
            self.known, self.rows = {}, self.rows[:0]
        parts = [words_of(t) for t in texts]
        known, new = self.known, []
        at = []
        for words in parts:
            for w in words:
                k = known.get(w)
                if k is None:
                    k = known[w] = len(known)
                    new.append(w)
                at.append(k)
        if new:
            self.rows = np.concatenate([self.rows, *(self.model.score(new[k : k + self.AT_ONCE]) for k in range(0, len(new), self.AT_ONCE))])
        count = np.array([len(p) for p in parts])
        out = np.zeros((len(texts), self.rows.shape[1]))
        full = np.flatnonzero(count)
        if len(full):
            out[full] = np.add.reduceat(self.rows[np.array(at)], (np.cumsum(count) - count)[full], axis=0)
        return out


class Model:
    def __init__(self, lm: KneserNey, limit: float):
        self.lm, self.limit = lm, limit


def held_out(parts: int):
    """Whether crc32(doc_id as text) mod parts is 0; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == 0, F.lit(False))


def train(docs: DataFrame, per_language: int = 1000, calibration: int = 300, limit_share: float = 0.75, most: int = 100_000) -> Model | None:
    """Learns from text and lang of the rows given, those with a null left out.

    Bounded: about `per_language` documents of each language for the model, of more than `most` in all fewer of each,
    and `calibration` others for the limit of rejection (those of 40 letters at least), chosen by hash of doc_id. Rows
    with a null doc_id are of one hash, and repeated rows count as often as they occur. No labelled row: None.
    """
    spark = docs.sparkSession
    rows = docs.where("text is not null and lang is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return None
    per_language = max(1, min(per_language, most // len(sizes)))
    spot = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, 1.0 / n))), F.col("lang"))
    rows = rows.withColumn("at", spot / share)
    chosen = rows.where(F.col("at") < per_language)

    def grams(batches):
        fresh()
        found: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found[lang].update(words_of(text))
        for lang, words in found.items():
            own: Counter = Counter()
            for w, c in words.items():
                padded = PAD * (ORDER - 1) + w + PAD
                for k in range(len(w) + 1):
                    own[padded[k : k + ORDER]] += c
            if own:
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(own), "gram": list(own), "n": pa.array(own.values(), pa.int64())})

    counted = chosen.select("lang", "text").mapInArrow(grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for lang, gram, n in zip(*(c.to_pylist() for c in counted.toArrow().columns), strict=True):  # of a bounded sample
        got[lang][gram] = n
    lm = KneserNey({lang: g for lang, g in got.items() if g}) if any(got.values()) else None
    if lm is None:
        return None
    shared = spark.sparkContext.broadcast(lm.plain())

    def calibrate(batches):
        fresh()
        release()
        scorer, rng = Scorer(KneserNey.rebuilt(shared.value)), random.Random(1)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            mixed = []
            for t in texts:
                letters = list("".join(words_of(t)))
                rng.shuffle(letters)
                it = iter(letters)
                mixed.append(" ".join("".join(next(it) for _ in w) for w in words_of(t)))
            best = [x[:, :-1].max(1) / -np.maximum(x[:, -1], 1) for x in (scorer(texts), scorer(mixed))]
            keep = scorer(texts)[:, -1] >= 40
            yield pa.RecordBatch.from_pydict({"own": best[0][keep], "mixed": best[1][keep]})

    spare = rows.where((F.col("at") >= per_language) & (F.col("at") < per_language + calibration)).select("text")
    pairs = spare.mapInArrow(calibrate, "own double, mixed double").toArrow()  # of a bounded sample
    if not pairs.num_rows:  # few rows: calibrate on what the model has seen
        pairs = chosen.where(F.col("at") < calibration).select("text").mapInArrow(calibrate, "own double, mixed double").toArrow()
    limit = float("inf")
    if pairs.num_rows:
        own, mixed = (float(np.median(pairs.column(c).to_numpy())) for c in ("own", "mixed"))
        most = 1.1 * float(np.quantile(pairs.column("own").to_numpy(), 0.99))  # texts like the labelled ones stay
        limit = max(most, own + limit_share * (mixed - own))
    return Model(lm, limit)


def identify(docs: DataFrame, model: Model | None, *columns: str) -> DataFrame:
    """Adds lang_pred, score, cross_entropy, letters and rejected to doc_id and the named columns.

    docs needs doc_id and text; a column named text is returned only if named. lang_pred is a learned language (ties:
    first in order), `und` if the text is null or without letters or the model is None; score, from 0 to 1, is the
    best language's share under the models, tempered by length; rejected is true for `und` and for texts of 20 or more
    letters whose cross-entropy is above the calibrated limit: of fewer, the cross-entropy says too little. Null and
    repeated doc_ids are kept as they are; whole texts count, of any length; an empty table gives an empty result.
    Columns named like a column of the result are an error.
    """
    if clash := set(columns) & {"doc_id", "lang_pred", "score", "cross_entropy", "letters", "rejected"}:
        raise ValueError(f"columns have names of the result: {sorted(clash)}")
    first = docs.select("doc_id", *columns).schema
    schema = type(first)(first.fields[:])
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("cross_entropy", "double"), ("letters", "long"), ("rejected", "boolean")):
        schema = schema.add(name, kind)
    shared = docs.sparkSession.sparkContext.broadcast((model.lm.plain(), model.limit) if model else None)
    place = "text" if "text" in columns else "__text"

    def run(batches):
        fresh()
        release()
        own = Model(KneserNey.rebuilt(shared.value[0]), shared.value[1]) if shared.value else None
        scorer = Scorer(own.lm) if own else None
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(place).to_pylist()]
            n = len(texts)
            if own:
                names = np.array(own.lm.languages, object)
                sums = np.concatenate([scorer(texts[k : k + 256]) for k in range(0, n, 256)]) if n else np.zeros((0, len(names) + 1))
                letters = sums[:, -1].astype(np.int64)
                entropy = sums[:, :-1] / -np.maximum(letters, 1)[:, None]
                best = entropy.argmin(1) if n else np.zeros(0, np.int64)
                least = entropy[np.arange(n), best]
                score = 1 / np.exp(-(entropy - least[:, None]) * np.sqrt(letters)[:, None]).sum(1)
                und = letters == 0
                pred, score = np.where(und, NONE, names[best]), np.where(und, 0.0, score)
                rejected = und | ((letters >= 20) & (least > own.limit))
            else:
                pred, score, least, letters, rejected = [NONE] * n, np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.ones(n, bool)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in first.names), pa.array(list(pred), pa.string()), pa.array(score, pa.float64()), pa.array(least, pa.float64()), pa.array(letters, pa.int64()), pa.array(rejected, pa.bool_())], schema.names)
        scorer = None
        release()

    text = [] if "text" in columns else [F.col("text").cast("string").alias(place)]
    return docs.select("doc_id", *columns, *text).mapInArrow(run, schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(5) & F.col("doc_id").isNotNull()))
    out = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", held_out(5).alias("held_out"), "lang_pred", "score", "rejected")
