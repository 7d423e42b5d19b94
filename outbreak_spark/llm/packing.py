"""Packing documents into token sequences by the sum-of-squares rule.

A document's ids, with an end id, are cut into full windows and a rest. Full windows are sequences of their own.
Each rest is placed, as it comes, into the fill level that makes the sum over levels of the squared number of
partly filled windows at that level least; a level array of `size` counters is all that a decision reads, so a
task's state is its open windows. Each task packs the documents that it reads and writes its pieces, without a shuffle.
The windows that are still open at a task's end, at most a few per level, then meet those of FAN_IN - 1 other tasks: whole
windows are placed by the same rule, and of those still open then, the emptiest are cut to fill the fullest. The last
few ids of such a group are cut at powers of two, so that there is no padding at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outbreak_spark.llm.common import Workspace, release
from outbreak_spark.llm.tokens import Encoder, drop_shared, shared_encoder, text_groups

NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Tasks whose open windows meet.
FAN_IN = 8


class SumOfSquares:
    """Open windows by fill level."""

    def __init__(self, size: int):
        self.size, self.count, self.open = size, np.zeros(size + 1, np.int64), {}

    def place(self, n: int) -> int:
        """The fill level, 0 for a new window, that an item of n < size ids goes to."""
        size, count = self.size, self.count
        best, least = 0, 2 * count[n] + 1  # growth of the sum of squares
        if n < size:
            old, new = count[1 : size - n + 1], count[n + 1 : size + 1]  # count[size] stays 0: full windows leave
            grow = np.where(old > 0, 2 * (new - old) + 2, np.iinfo(np.int64).max)
            if old[-1] > 0:
                grow[-1] = 1 - 2 * old[-1]
            k = len(grow) - 1 - int(np.argmin(grow[::-1]))  # ties to the fuller window
            if grow[k] <= least:
                best = k + 1
        return best

    def add(self, item, n: int):
        """Places the item; returns a window's items when it is full."""
        level = self.place(n)
        window = [item]
        if level:
            window = self.open[level].pop()
            window.append(item)
            self.count[level] -= 1
        level += n
        if level == self.size:
            return window
        self.open.setdefault(level, []).append(window)
        self.count[level] += 1
        return None

    def left(self) -> list[tuple[int, list]]:
        """(fill, items) of the windows still open, fullest first."""
        return [(level, w) for level in sorted(self.open, reverse=True) for w in self.open[level]]


def finish(windows: list[tuple[int, list]], size: int) -> tuple[list[list], int]:
    """Closes open windows (fill, items of (.., ids)): the final windows' items, and how many items were taken from their
    window, whole or in part. The last element of an item is its ids, the one before its start."""
    levels, done = SumOfSquares(size), []
    for fill, items in sorted(windows, key=lambda w: -w[0]):
        if full := levels.add(items, fill):
            done.append([x for part in full for x in part])
    rest = [(fill, [x for part in parts for x in part]) for fill, parts in levels.left()]
    moved, low = 0, len(rest)
    spare: list[tuple] = []
    for k in range(len(rest)):
        if k >= low:
            break
        room, items = size - rest[k][0], rest[k][1]
        while room:
            if not spare:
                if low - 1 <= k:
                    break
                low -= 1
                spare = rest[low][1][::-1]
                moved += len(spare)
            *head, start, ids = spare.pop()
            take = min(room, len(ids) // 4)
            items.append((*head, start, ids[: 4 * take]))
            if 4 * take < len(ids):
                spare.append((*head, start + take, ids[4 * take :]))
            room -= take
        if room:  # nothing is left to fill it with
            spare = items[::-1] + spare
            break
        done.append(items)
    left = sum(len(x[-1]) for x in spare) // 4
    while left:
        room, items = min(size, 1 << (left.bit_length() - 1)), []
        left -= room
        while room:
            *head, start, ids = spare.pop()
            take = min(room, len(ids) // 4)
            items.append((*head, start, ids[: 4 * take]))
            if 4 * take < len(ids):
                spare.append((*head, start + take, ids[4 * take :]))
            room -= take
        done.append(items)
    return done, moved


def _rows(windows: list[list], first: int) -> list[tuple]:
    """Pieces of windows whose items are (doc_id, doc_tokens, start, ids), numbered from `first` on."""
    out = []
    for sequence, items in enumerate(windows, first):
        offset = 0
        for doc_id, total, start, ids in items:
            out.append((doc_id, start, len(ids) // 4, total, sequence, offset, ids))
            offset += len(ids) // 4
    return out


def _table(rows: list[tuple], names: list[str]) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return [pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(cols, names, strict=True)]


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, most_pieces: int = 500_000) -> DataFrame:
    """Pieces of documents in sequences of at most `size` (a power of two) ids; a sequence is full or a power of two long.

    docs needs doc_id and text; other columns are ignored. One row per piece: doc_id, start (the document's ids before
    it), length, doc_tokens (with the end id), sequence_id, offset (in the sequence, gapless from 0), ids (binary,
    little-endian unsigned 32-bit). Null and empty texts are one end id. Null and repeated doc_ids are kept: each row
    is a document. most_pieces: how many distinct words and pieces a worker keeps encoded (fewer: less memory, more
    time). Sequence ids are unique, not consecutive. An empty table gives an empty result.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    work = Workspace(docs.sparkSession, "packing")

    def packed(batches):
        encoder, levels = shared_encoder(tokenizer, most_pieces), SumOfSquares(size)
        task = TaskContext.get().partitionId()
        sequence, held, weight = task << 36, [], 0
        names = [*NAMES, "group"]
        for batch in batches:
            of = batch.column("doc_id").to_pylist()
            for i, j, texts in text_groups(batch.column("text")):
                ids, count = encoder.ids(texts)
                ends = np.cumsum(count)
                for name, lo, hi in zip(of[i:j], ends - count, ends, strict=True):
                    own = np.r_[ids[lo:hi], np.uint32(end_id)].astype("<u4").tobytes()
                    total = len(own) // 4
                    for start in range(0, total, size):
                        piece = own[4 * start : 4 * (start + size)]
                        n, item = len(piece) // 4, (name, total, start, piece)
                        window = [item] if n == size else levels.add(item, n)
                        if window:
                            held += [(*r, None) for r in _rows([window], sequence)]
                            sequence, weight = sequence + 1, weight + size
                    if weight > 1 << 20:
                        yield pa.RecordBatch.from_arrays(_table(held, names), names)
                        held, weight = [], 0
        held += [(*r, task // FAN_IN) for r in _rows([w for _, w in levels.left()], sequence)]
        if held:
            yield pa.RecordBatch.from_arrays(_table(held, names), names)
        if most_pieces < Encoder.MOST_PIECES:  # memory is short
            drop_shared()
            release()

    def closed(key, table):
        cols = [table.column(c).to_pylist() for c in ("sequence_id", "offset", "doc_id", "doc_tokens", "start", "ids")]
        windows: dict[int, list] = {}
        for sequence, _, *item in sorted(zip(*cols, strict=True), key=lambda r: r[:2]):
            windows.setdefault(sequence, []).append(tuple(item))
        done, _ = finish([(sum(len(x[-1]) for x in w) // 4, w) for w in windows.values()], size)
        return pa.Table.from_arrays(_table(_rows(done, ((1 << 26) + key[0].as_py()) << 36), NAMES), NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pieces = work.write(rows.mapInArrow(packed, PIECES + ", group long"), "pieces")
    # Written, as only then are the batches short.
    last = work.write(pieces.where("group is not null").groupBy("group").applyInArrow(closed, PIECES), "last")
    return pieces.where("group is null").drop("group").unionByName(last)


def op5_pack_sum_of_squares(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
