"""Numerical cores of the operators without SQL against brute force; no session."""

import numpy as np
import pytest
from outbreak_spark.llm.ann import Block, Codebook
from outbreak_spark.llm.langid import ORDER, PAD, KneserNey, words_of


def grams_of(text):
    out = {}
    for w in words_of(text):
        padded = PAD * (ORDER - 1) + w + PAD
        for k in range(len(w) + 1):
            g = padded[k : k + ORDER]
            out[g] = out.get(g, 0) + 1
    return out


class ByHand:
    """Interpolated Kneser-Ney with dictionaries: counts at the highest order, distinct letters before at the lower ones."""

    def __init__(self, grams, letters):
        self.counts = {ORDER: dict(grams)}
        kinds = set(grams)
        for k in range(ORDER - 1, 0, -1):
            ends = {g[-k - 1 :] for g in kinds}
            self.counts[k] = {}
            for e in ends:
                self.counts[k][e[1:]] = self.counts[k].get(e[1:], 0) + 1
        self.uniform = 1 / (letters + 1)

    def p(self, gram):
        k = len(gram)
        if not k:
            return self.uniform
        own = self.counts[k]
        ones, twos = (sum(c == n for c in own.values()) for n in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        after = [c for g, c in own.items() if g[:-1] == gram[:-1]]
        if not after:
            return self.p(gram[1:])
        return max(own.get(gram, 0) - d, 0) / sum(after) + d * len(after) / sum(after) * self.p(gram[1:])


def test_kneser_ney_by_hand():
    texts = {"one": "the cat sat on the mat and the rat that sat at the bat a a aa", "two": "der hund und die katze und der und die das dass den dem é straße"}
    grams = {k: grams_of(t) for k, t in texts.items()}
    model, letters = KneserNey(grams), {g[-1] for own in grams.values() for g in own}
    by_hand = [ByHand(grams[k], len(letters)) for k in model.languages]
    rng = np.random.default_rng(1)
    some = [*grams["one"], *grams["two"], *("".join(rng.choice([*letters, "q", "ß"], ORDER)) for _ in range(200))]
    points = np.array(some, f"<U{ORDER}").view(np.uint32).reshape(-1, ORDER)
    got = model.probabilities(points, ORDER)
    assert np.allclose(got, [[m.p(g) for m in by_hand] for g in some], rtol=1e-5)
    word = "that"
    padded = PAD * (ORDER - 1) + word + PAD
    want = [sum(np.log(m.p(padded[k : k + ORDER])) for k in range(len(word) + 1)) for m in by_hand]
    assert np.allclose(model.score([word, "und"])[0], [*want, len(word) + 1], rtol=1e-5)
    again = KneserNey.rebuilt(model.plain())
    assert (again.probabilities(points, ORDER) == got).all() and again.languages == model.languages


def test_codes_find_the_nearest_of_many():
    """Of 20,000 vectors in clusters, the best 2 % by their codes hold the nearest 20; codes at random would hold 2 % of them."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 64))
    x = centres[rng.integers(0, 10, 20_000)] + rng.normal(size=(20_000, 64)) * 0.9
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    book = Codebook(x[:8192])
    codes, queries = book.pack(book.encode(x)), x[::400]
    tables, scores = book.tables(queries), np.zeros((len(x), len(queries)), np.float32)
    for m in range(codes.shape[1]):
        scores += tables[m][codes[:, m]]
    exact, hits = x @ queries.T, 0
    for q in range(len(queries)):
        hits += len(np.intersect1d(np.argsort(-exact[:, q])[:20], np.argsort(-scores[:, q])[:400]))
    assert hits >= 0.9 * 20 * len(queries)


@pytest.mark.parametrize("kind", ["near copies", "lengths", "scales", "unlike the sample", "huge"])
def test_search_finds_the_nearest_of_rows_that_codes_confuse(kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "near copies":
        x = x[rng.integers(0, 3, 6000)] + 1e-4 * rng.normal(size=x.shape)
    elif kind == "lengths":
        x *= np.exp(1.5 * rng.normal(size=(6000, 1)))
    elif kind == "scales":
        x *= np.exp(-np.arange(32) / 4)
    elif kind == "unlike the sample":
        x[4000:] = 40 * x[0] + x[4000:]
    else:
        x *= 1e150
    book = Codebook(x[:4000])
    block, at = Block(book, book.pack(book.encode(x)), x, np.arange(6000)), np.arange(0, 6000, 60)
    hits = 0
    for q, (found, score) in zip(at, block.best(x[at], at, 20, 200), strict=True):
        true = x @ x[q]
        assert np.allclose(score, true[found], rtol=1e-12) and q not in found
        true[q] = -np.inf
        hits += (score >= np.sort(true)[-20] * (1 - 1e-12)).sum()
    assert hits >= 0.99 * 20 * len(at)
