"""Substring deduplication by difference-cover anchors.

A difference cover D modulo v holds, for every difference, two residues with that difference. So for any two equal
windows of w words at positions i and j of their documents, some shift d < v puts i + d and j + d both on cover
positions: both documents hash the same w - v + 1 words there. Only |D| / v of the positions are hashed (5 of 21):

1. anchors: hash w - v + 1 words at cover positions; anchors whose hash occurs elsewhere mark the up to v window
   starts that hold them as candidates;
2. extension: candidates are extended to their whole w words, and equal ones are matched by 128 bits of hash, from two
   independent hashes of each word, so that no false match is to be expected in any corpus;
3. covered words are removed.

Nothing is done by pairs: a passage in a third of all documents costs one entry per flush and position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outbreak_spark.llm.common import KEY, RANGES, SENT, Exchange, WordHashes, Workspace, doc_ranges, flushes, keyed, keys_blob, keys_of, one_per_key, runs, sliced, text_bytes, window_hashes

#: Perfect difference sets, each with its modulus.
DIFFERENCE_SETS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (0, 1, 3, 7, 15, 31, 36, 54, 63)}


def cover_for(window: int) -> tuple[int, np.ndarray]:
    """The largest period of at most two thirds of the window, with its cover as a mask."""
    period = max(v for v in DIFFERENCE_SETS if v == 1 or v <= 2 * window / 3)
    mask = np.zeros(period, bool)
    mask[list(DIFFERENCE_SETS[period])] = True
    return period, mask


def _hashed(held_texts: list[bytes], cache: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a flush, the documents' starts among them, and each word's place in its document."""
    each = [cache.of(t.split()) for t in held_texts]
    lens = np.array([len(x) for x in each], np.int64)
    starts = np.r_[0, np.cumsum(lens)]
    place = np.arange(starts[-1]) - np.repeat(starts[:-1], lens)
    return np.concatenate(each) if each else np.empty(0, np.uint64), starts, place


def repeated_ranges(docs: DataFrame, window: int, work: Workspace, most_buckets: int = 512) -> DataFrame:
    """Row key and ranges of words [lo, hi) that repeated windows cover, for documents that have any."""
    period, cover = cover_for(window)
    anchor = window - period + 1
    exchange = Exchange(text_bytes(docs), most=most_buckets)

    def anchors(batches):
        cache = WordHashes()
        for flush, (keys, texts) in flushes(batches, [KEY, "text"]):
            unit, starts, place = _hashed(texts, cache)
            h = window_hashes(unit, anchor)
            end = np.repeat(starts[1:], np.diff(starts))[: len(h)]
            long_enough = np.repeat(np.diff(starts) >= window, np.diff(starts))[: len(h)]
            at = np.flatnonzero(cover[place[: len(h)] % period] & (np.arange(len(h)) + anchor <= end) & long_enough)
            yield exchange.send(flush, h[at], at, (keys_blob(keys), starts.astype("<i8").tobytes()), short=True)

    def candidates(own, at: np.ndarray) -> pa.Table:
        keys, starts = keys_of(own[0]), np.frombuffer(own[1], "<i8")
        at = at.astype(np.int64)
        doc = np.searchsorted(starts, at, side="right") - 1
        lo, hi = np.maximum(at - period + 1, starts[doc]), np.minimum(at, starts[doc + 1] - window) + 1
        keep = lo < hi
        lo, hi = lo[keep], hi[keep]
        if not len(lo):
            return doc_ranges(keys, starts, lo, hi)
        new = np.r_[True, lo[1:] > np.maximum.accumulate(hi)[:-1]] | np.r_[True, np.diff(doc[keep]) != 0]
        first = np.flatnonzero(new)
        return doc_ranges(keys, starts, lo[first], np.maximum.reduceat(hi, first))

    rows = keyed(docs)
    found = work.write(exchange.repeats(rows.mapInArrow(anchors, SENT), candidates, RANGES), "anchors")
    found = one_per_key(found)

    def windows(batches):
        cache, other = WordHashes(), WordHashes(seed=1)
        for flush, (keys, texts, ranges) in flushes(batches, [KEY, "text", "ranges"]):
            unit, starts, _ = _hashed(texts, cache)
            h, more = window_hashes(unit, window), window_hashes(_hashed(texts, other)[0], window)
            marks = np.zeros(len(unit) + 1, np.int64)
            for s, r in zip(starts, ranges, strict=False):
                lo, hi = np.frombuffer(r, "<i8").reshape(-1, 2).T + s
                np.add.at(marks, lo, 1)
                np.add.at(marks, hi, -1)
            at = np.flatnonzero(np.cumsum(marks)[: len(h)] > 0)
            yield exchange.send(flush, h[at], at, (keys_blob(keys), starts.astype("<i8").tobytes()), more=more[at])

    def covered(own, at: np.ndarray) -> pa.Table:
        keys, starts = keys_of(own[0]), np.frombuffer(own[1], "<i8")
        first, last = runs(at.astype(np.int64))
        if not len(first):
            return doc_ranges(keys, starts, first.astype(np.int64), last.astype(np.int64))
        lo, hi = first, last + window
        doc = np.searchsorted(starts, lo, side="right") - 1
        # A run of starts over a document's end is cut there by itself: no window crosses it. Overlaps are joined.
        new = np.flatnonzero(np.r_[True, (lo[1:] > hi[:-1]) | (doc[1:] != doc[:-1])])
        return doc_ranges(keys, starts, lo[new], np.r_[hi[new[1:] - 1], hi[-1]])

    picked = work.attach(rows, "anchors", found, KEY, "inner").select(KEY, "text", "ranges")
    return one_per_key(work.write(exchange.repeats(picked.mapInArrow(windows, SENT), covered, RANGES), "covered"))


def remove_repeated_windows(docs: DataFrame, window: int = 35, most_buckets: int = 512) -> DataFrame:
    """Each document without the words that a repeated window of so many words covers.

    docs needs doc_id and text; other columns are ignored. Returns doc_id, text (kept words joined by one space),
    n_words, n_removed and ranges (binary, pairs of int64: removed word ranges; null if none).
    Null and empty texts have no words; a doc_id may be null or repeat; a repeated row counts as another document,
    so all its windows repeat. An empty table gives an empty result. most_buckets: see Exchange.
    """
    work = Workspace(docs.sparkSession, "cover")
    found = repeated_ranges(docs, window, work, most_buckets)

    def kept(batches):
        for batch in sliced(batches):
            texts, total, gone = [], [], []
            for text, r in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                words = text.split()
                total.append(len(words))
                if r is not None:
                    for lo, hi in np.frombuffer(r, "<i8").reshape(-1, 2)[::-1]:
                        del words[lo:hi]
                gone.append(total[-1] - len(words))
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), batch.column("ranges")], ["doc_id", "text", "n_words", "n_removed", "ranges"])

    rows = work.attach(keyed(docs, F.col("doc_id").cast("long").alias("doc_id")), "covered", found, KEY, "left")
    out = rows.select("doc_id", "text", "ranges").mapInArrow(kept, "doc_id long, text binary, n_words long, n_removed long, ranges binary")
    return out.withColumn("text", F.col("text").cast("string"))


def op9_cover_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeated_windows(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
