"""Exact substring deduplication by a depth-limited radix sort of suffixes.

Suffixes are ordered only through `window` bytes, by most-significant-digit passes of 8 bytes each: a pass splits
groups by their next digit, suffixes alone in their group drop out, and what is left after the last pass are
exactly the windows that repeat, compared byte by byte.

All suffixes of a large corpus can't be sent to a sort, so two things happen first. Each window is assigned to its
anchor, the n-gram of least hash in it (leftmost if tied): equal windows have equal anchors at equal offsets, and
neighbouring windows mostly share theirs, so a run of windows travels as one short segment. And only runs whose
anchor's hash occurs elsewhere travel at all. The anchor and the offset in it are the sort's first digit, by which
segments are dealt to tasks; the other digits are bytes.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outbreak_spark.llm.common import KEY, SENT, U64, Exchange, Workspace, buckets_for, doc_ranges, flush_key, flushes, keyed, keys_blob, keys_of, mix, one_per_key, parts, release, sent, sliced, text_bytes

#: Start positions that are hashed at a time.
CHUNK = 1 << 19
#: Text bytes of a flush: segments of one are held at once.
FLUSH = 5 << 20
MARKS = f"{KEY} binary, marks binary"


def _grams(buf: bytes, lo: int, hi: int, gram: int) -> np.ndarray:
    """Hashes of the n-grams that start at lo .. hi - 1; gram is a multiple of 8."""
    n = hi - lo + gram - 8
    h = np.ndarray((n,), "<u8", buf, lo, (1,)) * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(31)
    size = 8
    while size < gram:
        step = min(size, gram - size)
        h = mix(h[: len(h) - step], h[step:])
        size += step
    return h


def anchor_runs(buf: bytes, starts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Maximal runs [lo, hi) of window starts with the same anchor, the anchor's place and hash.

    A run depends on its document alone: chunks are cut between runs.
    """
    out: list[tuple] = []
    least, reach = starts[:-1], window - gram + 1
    ends = starts[1:] - window + 1  # first start that is too late, by document
    at, last = 0, int(starts[-1]) - window + 1
    while at < last:
        to = min(at + CHUNK, last)
        h = _grams(buf, at, to + reach - 1, gram)
        key = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
        size = 1
        while size < reach:
            step = min(size, reach - size)
            key = np.minimum(key[: len(key) - step], key[step:])
            size += step
        valid = np.ones(to - at, bool)
        for d in range(max(0, np.searchsorted(starts, at, side="right") - 1), np.searchsorted(least, to)):
            valid[max(0, max(ends[d], least[d]) - at) : max(0, starts[d + 1] - at)] = False
        start = np.flatnonzero(valid)
        if len(start):
            anchor = (key[start] & U64(0xFFFFFFFF)).astype(np.int64)
            new = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(start) != 1)])
            lo, hi, a = start[new], np.r_[start[new[1:] - 1], start[-1]] + 1, anchor[new]
            nxt = to
            if to < last and hi[-1] == to - at:
                nxt = at + int(lo[-1])
                if nxt == at:  # can't be: a run is no longer than reach
                    raise AssertionError("run longer than a chunk")
                lo, hi, a = lo[:-1], hi[:-1], a[:-1]
            out.append((lo + at, hi + at, a + at, h[a]))
            at = nxt
        else:
            at = to
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + (np.empty(0, U64),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def radix_groups(buf: bytes, pos: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Indices into pos of the suffixes whose first `window` bytes another suffix of the same group has too.

    Most-significant-digit passes. group: the digit by which they were dealt. Groups that a digit doesn't split
    aren't sorted again.
    """
    idx = np.argsort(group, kind="stable")
    g = group[idx]
    for depth in [-1, *range(0, window - 8, 8), window - 8]:
        if depth >= 0:
            digit = np.ndarray((len(buf) - 7,), ">u8", buf, 0, (1,))[pos[idx] + depth].astype(U64)
            same = g[1:] == g[:-1]
            split = same & (digit[1:] != digit[:-1])
            if split.any():
                number = np.cumsum(np.r_[0, ~same])
                mixed = np.zeros(number[-1] + 1, bool)
                mixed[number[1:][split]] = True
                m = np.flatnonzero(mixed[number])
                order = np.lexsort((digit[m], number[m]))
                idx[m], digit[m] = idx[m][order], digit[m][order]
            new = np.r_[True, ~same | (digit[1:] != digit[:-1])]
        else:
            new = np.r_[True, g[1:] != g[:-1]]
        g = np.cumsum(new)
        keep = ~(new & np.r_[new[1:], True])
        idx, g = idx[keep], g[keep]
        if not len(idx):
            break
    return idx


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... n[0] values, and so on."""
    return np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def repeated_ranges(docs: DataFrame, window: int, work: Workspace, most_buckets: int = 512) -> DataFrame:
    """Row key and byte ranges [lo, hi) that repeated windows cover, for documents that have any."""
    gram = min(48, max(8, window // 4 // 8 * 8))
    total = text_bytes(docs)
    exchange, fine = Exchange(total, most=most_buckets), buckets_for(total, 4 << 20)
    bounds = lambda texts: np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    rows = keyed(docs)

    def anchors(batches):
        for flush, (keys, texts) in flushes(batches, [KEY, "text"], FLUSH):
            starts = bounds(texts)
            lo, _, _, h = anchor_runs(b"".join(texts) + bytes(8), starts, window, gram)
            yield exchange.send(flush, h, lo, (keys_blob(keys), starts.astype("<i8").tobytes()), short=True)

    def candidates(own, at):
        keys, starts, at = keys_of(own[0]), np.frombuffer(own[1], "<i8"), at.astype(np.int64)
        doc = np.searchsorted(starts, at, side="right") - 1
        which, first = np.unique(doc, return_index=True)
        flat = (at - starts[doc]).astype("<u4")
        return pa.table({KEY: pa.array(keys[which].tolist(), pa.binary()), "marks": pa.array([flat[i:j].tobytes() for i, j in zip(first, np.r_[first[1:], len(doc)][: len(first)], strict=True)], pa.binary())})

    found = work.write(exchange.repeats(rows.mapInArrow(anchors, SENT), candidates, MARKS), "anchors").groupBy(KEY).agg(F.max("marks").alias("marks"))

    def segments(batches):
        for flush, (keys, texts, marks) in flushes(batches, [KEY, "text", "marks"], FLUSH):
            starts = bounds(texts)
            buf = b"".join(texts) + bytes(8)
            lo, hi, anchor, h = anchor_runs(buf, starts, window, gram)
            wanted = np.concatenate([np.frombuffer(m, "<u4").astype(np.int64) + s for m, s in zip(marks, starts, strict=False)])
            pick = np.isin(lo, wanted, assume_unique=False)
            lo, hi, anchor, h = lo[pick], hi[pick], anchor[pick], h[pick]
            seen: dict[bytes, int] = {}
            twins: dict[int, list[int]] = defaultdict(list)
            for k, (i, j) in enumerate(zip(lo.tolist(), (hi - 1 + window).tolist(), strict=True)):
                one = seen.setdefault(buf[i:j], k)
                if one != k:
                    twins[one].append(k)
            both = np.array([x for one, more in twins.items() for x in (one, *more)], np.int64)
            known = np.stack([lo[both], hi[both]], 1).astype("<u4").tobytes()
            out = [(flush_key(flush), flush, known, keys_blob(keys), starts.astype("<i8").tobytes(), None)]
            one = np.fromiter(seen.values(), np.int64, len(seen))
            for k, at in parts((h[one] % U64(fine)).astype(np.int64)):
                m = one[at]
                head = np.stack([h[m], lo[m].astype(U64), (anchor[m] - lo[m]).astype(U64), (hi[m] - lo[m]).astype(U64)], 1).astype("<u8")
                out.append((k, flush, head.tobytes(), b"".join(buf[lo[x] : hi[x] - 1 + window] for x in m), None, None))
            yield sent(out)

    def radix_sort(key, table):
        if key[0].as_py() < 0:
            return table
        flush, a, b = (table.column(x).to_pylist() for x in ("flush", "a", "b"))
        head = np.concatenate([np.frombuffer(x, "<u8").reshape(-1, 4) for x in a])
        owner = np.repeat(np.arange(len(flush)), [len(x) // 32 for x in a])
        anchor = np.unique(head[:, 0], return_inverse=True)[1].astype(np.int64)
        lo, rel, n = (head[:, k].astype(np.int64) for k in (1, 2, 3))
        offset = np.r_[0, np.cumsum(n - 1 + window)[:-1]]
        segment = np.repeat(np.arange(len(n)), n)
        pos = _spread(offset, n)
        group = anchor[segment] * (window + 1) + (rel[segment] - (pos - offset[segment]))
        hit = np.sort(radix_groups(b"".join(b), pos, group, window))
        seg, at = segment[hit], lo[segment[hit]] + pos[hit] - offset[segment[hit]]
        out = []
        if len(hit):
            new = np.flatnonzero(np.r_[True, (np.diff(seg) != 0) | (np.diff(at) != 1)])
            pair, who = np.stack([at[new], np.r_[at[new[1:] - 1], at[-1]] + 1], 1).astype("<u4"), owner[seg[new]]
            out = [(key[0].as_py(), flush[k], pair[m].tobytes(), None, None, None) for k, m in parts(who)]
        if len(pos) > 1 << 20:
            del head, segment, pos, group
            release()
        return pa.Table.from_batches([sent(out)])

    def covered(key, table):
        own, pairs = None, []
        for a, b, c in zip(*(table.column(x).to_pylist() for x in ("a", "b", "c")), strict=True):
            pairs.append(np.frombuffer(a, "<u4").reshape(-1, 2))
            own = (b, c) if b is not None else own
        keys, starts = keys_of(own[0]), np.frombuffer(own[1], "<i8")
        lo, hi = np.concatenate(pairs).astype(np.int64).T
        if not len(lo):
            return doc_ranges(keys, starts, lo, hi)
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], hi[order] - 1 + window
        doc = np.searchsorted(starts, lo, side="right") - 1
        new = np.flatnonzero(np.r_[True, (lo[1:] > np.maximum.accumulate(hi)[:-1]) | (np.diff(doc) != 0)])
        return doc_ranges(keys, starts, lo[new], np.maximum.reduceat(hi, new))

    picked = work.attach(rows, "anchors", found, KEY, "inner", small=False).select(KEY, "text", "marks")
    found = picked.mapInArrow(segments, SENT).groupBy("bucket").applyInArrow(radix_sort, SENT).groupBy("flush").applyInArrow(covered, f"{KEY} binary, ranges binary")
    return one_per_key(work.write(found, "covered"))


def remove_repeated_bytes(docs: DataFrame, window: int = 200, *columns: str, most_buckets: int = 512) -> DataFrame:
    """Each document without the bytes that a repeated string of `window` (at least 9) bytes covers.

    docs needs doc_id and text; of other columns, those named are carried along. Returns doc_id, the named columns,
    kept (binary, what is left of the UTF-8 bytes), n_bytes, n_removed, n_spans (maximal removed runs) and ranges
    (binary, pairs of int64; null if none). Null text is empty; a doc_id may be null or repeat; a repeated row counts
    as another document, so all its windows repeat. Empty tables give empty results. Columns named like a column of the
    result are an error. most_buckets: see Exchange.
    """
    if window < 9:
        raise ValueError("window must be 9 at least")
    if clash := set(columns) & {"doc_id", "kept", "n_bytes", "n_removed", "n_spans", "ranges"}:
        raise ValueError(f"columns have names of the result: {sorted(clash)}")
    work = Workspace(docs.sparkSession, "suffix")
    found = repeated_ranges(docs, window, work, most_buckets)
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).schema

    def kept(batches):
        for batch in sliced(batches):
            left, total, gone, spans = [], [], [], []
            for text, r in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                total.append(len(text))
                pairs = np.frombuffer(r or b"", "<i8").reshape(-1, 2).tolist()
                spans.append(len(pairs))
                if pairs:
                    cuts = [0, *(x for p in pairs for x in p), len(text)]
                    text = b"".join(text[cuts[k] : cuts[k + 1]] for k in range(0, len(cuts), 2))
                gone.append(total[-1] - len(text))
                left.append(text)
            more = [pa.array(left, pa.binary()), *(pa.array(x, pa.int64()) for x in (total, gone, spans)), batch.column("ranges")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in first.names), *more], [*first.names, "kept", "n_bytes", "n_removed", "n_spans", "ranges"])

    rows = work.attach(keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), *columns), "covered", found, KEY, "left")
    out = type(first)(first.fields[:])
    for name, kind in (("kept", "binary"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("ranges", "binary")):
        out = out.add(name, kind)
    return rows.select(*first.names, "text", "ranges").mapInArrow(kept, out)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeated_bytes(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
