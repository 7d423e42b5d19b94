"""The registered queries over the smallest tables: those with SQL against DuckDB, the others against their contracts."""

import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from outbreak_spark.llm.queries import ORACLE_SQL, QUERIES
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(duck):
    return {k: t or "" for k, t in duck.sql("select doc_id, text from documents").fetchall()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df, want = QUERIES[name](spark, DATA), duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def held(k, n):
    return zlib.crc32(str(k).encode()) % n == 0


def test_language_query(spark, duck, texts):
    got = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, DATA).collect()}
    lang = dict(duck.sql("select doc_id, lang from documents").fetchall())
    assert set(got) == set(texts) and all(r.held_out == held(k, 5) and 0 <= r.score <= 1 for k, r in got.items())
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts[k])) for k, r in got.items())
    own = [k for k in got if held(k, 5) and lang[k]]
    assert np.mean([got[k].lang_pred == lang[k] for k in own]) > 0.9


def test_model_query(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op4_log_bilinear_lm"](spark, DATA).collect()}
    assert set(got) == set(texts) and all(r.held_out == held(k, 10) and np.isfinite(r.score) and r.score < 0 for k, r in got.items())
    own = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)  # better than unigrams on texts it hasn't seen


def test_packing_query(spark, texts):
    tokenizer, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    tokenizer.encode_special_tokens = True
    windows = {}
    for r in QUERIES["op5_pack_sum_of_squares"](spark, DATA).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    filled = 0
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)  # full, or a power of two: no padding
        filled += at == 1024
    assert filled >= 0.9 * len(windows)
    for k, t in texts.items():
        ids, at = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_file_query(spark, texts):
    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    tokenizer.encode_special_tokens = True
    got = {r.doc_id: r for r in QUERIES["op6_token_files"](spark, DATA).collect()}
    for k in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[k], add_special_tokens=False).ids, 2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_mixing_query(spark, duck, texts):
    rows, source = QUERIES["op7_pivotal_mix"](spark, DATA).collect(), dict(duck.sql("select doc_id, source from documents").fetchall())
    whole, taken, target, longest = {}, {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        assert r.size == len(texts[r.doc_id].encode().split()) and r.taken in (0, r.size, 2 * r.size)
        whole[s], taken[s], target[s], longest[s] = whole.get(s, 0) + r.size, taken.get(s, 0) + r.taken, r.target, max(longest.get(s, 0), r.size)
    assert len(rows) == len(texts) and all(abs(taken[s] - target[s]) <= longest[s] for s in whole)
    names = sorted(whole, key=lambda s: (s is None, s or ""))
    weight, fixed = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, {}
    while True:
        left = 1.5 * sum(whole.values()) - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        want = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 2.0 * whole[s] for s in free if want[s] > 2 * whole[s]}
        if not over:
            break
        fixed |= over
    assert all(abs(target[s] - (want | fixed)[s]) < 1e-6 for s in names)


def test_search_query(spark, duck):
    rows = [(k, np.array(e, float)) for k, e in duck.sql("select vec_id, embedding from embeddings").fetchall() if e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    ids, x, got = np.array([k for k, _ in rows]), np.stack([e for _, e in rows]), {}
    for r in QUERIES["op8_anisotropic_ann"](spark, DATA).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {k for k, _ in rows if k % 20 == 0}
    hits = 0
    for k, e in rows:
        if k % 20 == 0:
            s = x @ e
            s[ids == k] = -np.inf
            best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
            hits += len(best & {v for v, _ in got[k].values()})
            assert all(abs(s[np.flatnonzero(ids == v)[0]] - score) < 1e-9 for v, score in got[k].values())
    assert hits >= 0.9 * 20 * len(got)
