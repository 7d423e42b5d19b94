"""Shared pieces of the training-data operators: shared folder, flushes of documents, hashing, exchange of hashes.

Several operators find equal pieces of text over the whole corpus. They all move *blobs* instead of rows: a map
task turns its documents into flushes (a few MB of text), hashes with numpy, and sends one binary row for each
(flush, hash bucket). A bucket task sees each hash at most once per flush, because equal hashes inside a flush
are collapsed before the exchange; so a hash that a third of all rows share costs one entry per flush.
What a bucket finds goes back to its flush as one more blob, and there becomes ranges per document.
With many buckets that would be a row for each of flushes x buckets, so the exchange then has two levels: see Exchange.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text bytes that one flush gathers before it is hashed.
FLUSH_BYTES = 24 << 20
#: A side table is broadcast only if its files, as measured, are no larger than this.
BROADCAST_BYTES = 16 << 20
KEY = "__row_key"
ARROW_ROWS, MOST_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500
#: Rows that one key may have before its side of a join is dealt by broadcast: at most N / HOT_ROWS keys have more.
HOT_ROWS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it's unset, a temporary one, which only a
    local master allows: elsewhere executors and driver have different disks."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, where[len("file://") :], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextlib.contextmanager
def short_batches(spark: SparkSession):
    """Inside, Arrow batches have few rows, as rows hold whole texts; the session's own limit is put back after."""
    had = spark.conf.get(ARROW_ROWS, "10000")
    short = int(had) not in range(1, MOST_ARROW_ROWS + 1)
    if short:
        spark.conf.set(ARROW_ROWS, str(MOST_ARROW_ROWS))
    try:
        yield
    finally:
        if short:
            spark.conf.set(ARROW_ROWS, had)


def sliced(batches, rows: int = 512):
    """Batches of a plan that runs with the session's own limit, a few rows at a time: what a task makes of whole texts
    is then never a copy of a whole batch."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)
    release()


_ROOTS: list[Workspace] = []


def clean(spark: SparkSession) -> None:
    """Deletes all that the operators wrote to the shared folder, which their results may still read: call it when those
    are written or collected."""
    while _ROOTS:
        _ROOTS.pop().drop("")


class Workspace:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _ROOTS.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def write(self, df: DataFrame, name: str) -> DataFrame:
        with short_batches(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def bytes(self, name: str) -> int:
        fs, path = self._fs(name)
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = self._fs(name)
            fs.delete(path, True)

    def attach(self, docs: DataFrame, name: str, side: DataFrame, on: str, how: str, small: bool = True) -> DataFrame:
        """Join documents with a table of this workspace. Broadcast only if it's meant to be small and its measured
        size allows; else a shuffled join."""
        if small and self.bytes(name) <= BROADCAST_BYTES:
            return docs.join(F.broadcast(side), on, how)
        return docs.join(side.hint("merge"), on, how)


def spread_join(rows: DataFrame, side: DataFrame, on: str, size: str) -> DataFrame:
    """rows inner join side, which has one row per value of `on`, with the number of rows of it in the column `size`.

    Values with more than HOT_ROWS rows would each be one task's work: they are joined by broadcast (at most one in
    HOT_ROWS rows can be such a value, and no more than a million are sent, those with most rows), the others by shuffle.
    """
    limit = HOT_ROWS
    while (hot := side.where(F.col(size) > limit).count()) > 1_000_000:
        limit *= 2
    if not hot:
        return rows.join(side, on)
    few, many = F.broadcast(side.where(F.col(size) > limit)), side.where(F.col(size) <= limit)
    return rows.join(few, on).unionByName(rows.join(F.broadcast(side.where(F.col(size) > limit).select(on)), on, "left_anti").join(many, on))


def plain(x):
    """An object's attributes, for a broadcast: workers may not find its class by name, and closures bring it along."""
    return vars(x)


def rebuilt(kind: type, attributes: dict):
    """The object of a class with such attributes."""
    x = kind.__new__(kind)
    vars(x).update(attributes)
    return x


def row_key() -> Column:
    """A key of 128 bits that equal rows share; doc_id may be null or repeat with another text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00null"))
    return F.unhex(F.md5(F.concat_ws("\x01", name, F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary")))


def keys_blob(keys: list[bytes]) -> bytes:
    return b"".join(keys)


def keys_of(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "V16")


def keyed(docs: DataFrame, *columns) -> DataFrame:
    """Row key, the columns, and text as bytes, empty if null."""
    return docs.select(row_key().alias(KEY), *columns, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one narrow pass, whose result sizes all buckets of an operator."""
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


def buckets_for(total: int, per_bucket: int, least: int = 8) -> int:
    """Number of hash buckets, a power of two: one for so many bytes of text."""
    return max(least, 1 << max(0, int(np.ceil(np.log2(max(1, total / per_bucket))))))


# --- hashing ---------------------------------------------------------------------------------------------------


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of an ordered pair of 64-bit hashes, elementwise."""
    x = a ^ (a >> U64(32))
    x *= U64(0x9E3779B97F4A7C15)
    x += b * U64(0xC2B2AE3D27D4EB4F)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


def window_hashes(unit: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of so many units, by doubling; len(unit) - length + 1 of them."""
    if len(unit) < length:
        return np.empty(0, U64)
    have, size = unit, 1
    while size < length:
        step = min(size, length - size)
        have = mix(have[: len(have) - step], have[step:])
        size += step
    return have


class WordHashes(dict):
    """Word -> 64-bit hash. A cache only: it is emptied when it grows."""

    MOST = 300_000

    def __init__(self, seed: int = 0):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.MOST:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


# --- flushes ---------------------------------------------------------------------------------------------------


def flushes(batches, columns: list[str], limit: int = FLUSH_BYTES):
    """(flush id, lists of the columns) with about so many bytes of the column text each."""
    fresh()
    part, seq, size = TaskContext.get().partitionId(), 0, 0
    held: list[list] = [[] for _ in columns]
    at = columns.index("text")
    for batch in batches:
        for k in range(0, len(batch), 1024):
            for row in zip(*(batch.column(c).slice(k, 1024).to_pylist() for c in columns), strict=True):
                for have, x in zip(held, row, strict=True):
                    have.append(x)
                size += len(row[at])
                if size >= limit:
                    yield (part << 24) | seq, held
                    held, size, seq = [[] for _ in columns], 0, seq + 1
    if held[0]:
        yield (part << 24) | seq, held
    held = []
    release()


def fresh() -> None:
    """For tasks that don't encode: drops what an earlier task of this worker process keeps for later encoders."""
    tokens = sys.modules.get("outbreak_spark.llm.tokens")
    if tokens and tokens.drop_shared():
        release()


def release() -> None:
    """Hands a worker's free memory back to the system: workers are used again, and executors have hard limits."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


SENT = "bucket long, flush long, a binary, b binary, c binary, d binary"


SUMMARY = -(1 << 62)


def sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "flush", "a", "b", "c", "d"])


def flush_key(flush: int) -> int:
    """A bucket number of its own, below 0, for what only the flush needs."""
    return -1 - flush


def collapse(hashes: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of one entry for each hash (of 128 bits if `more` is given), and a mask of those that occur again here."""
    order = np.argsort(hashes, kind="stable") if more is None else np.lexsort((more, hashes))
    s = hashes[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if more is not None:
        t = more[order]
        new[1:] |= t[1:] != t[:-1]
    twin = ~new
    twin[:-1] |= ~new[1:]
    mask = np.zeros(len(s), bool)
    mask[order[twin]] = True
    return order[new], mask


def parts(values: np.ndarray):
    """(value, indices of it) for each value that occurs: nothing is done for those that don't."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(s)], strict=False):
        yield int(s[lo]), order[lo:hi]


class Exchange:
    """Meets equal hashes of all flushes, and answers each flush.

    repeats: which of its entries have a hash that occurs again, anywhere. totals: the sum of the values sent with each
    hash; a flush sends each hash once. Up to `most` buckets, a flush sends a row to each bucket. Beyond, to one of about
    sqrt(buckets) coarse ones; there about sqrt(flushes) flushes meet, their equal hashes are collapsed once more, and
    one row goes on for all of them to each fine bucket that occurs; answers come back on the same way. So with n
    flushes and buckets n^1.5 rows are sent, and not n^2, and a hash that all flushes have is sqrt(n) entries in its bucket.
    """

    def __init__(self, total: int, per_bucket: int = 24 << 20, most: int = 512, totals: bool = False, summary=None):
        """summary: with totals, a function of a bucket's hashes and their sums that gives (a, b, c, d) for one more row,
        whose bucket is SUMMARY."""
        self.buckets, self.totals, self.summary = buckets_for(total, per_bucket), totals, summary
        bits = self.buckets.bit_length() - 1
        self.coarse = self.buckets if self.buckets <= most else 1 << ((bits + 1) // 2)

    def send(self, flush: int, hashes: np.ndarray, ordinals: np.ndarray, own: tuple, more: np.ndarray | None = None, short: bool = False) -> pa.RecordBatch:
        """One row per bucket, and one for the flush itself with its own data and what it already knows to repeat.

        more: the hashes' second 64 bits, or with totals the values. short: 32 bits of each hash besides the bucket are
        enough, as a false match only costs time.
        """
        if self.totals:
            one, known = np.arange(len(hashes)), ordinals[:0]
        else:
            one, twice = collapse(hashes, more)
            known = np.sort(ordinals[twice])
        rows = [(flush_key(flush), flush, known.astype("<u4").tobytes(), *own, *[None] * (3 - len(own)))]
        h, o = hashes[one], ordinals[one].astype("<u4")
        m = more[one].astype("<u8") if more is not None else None
        short = short and self.coarse == self.buckets
        for k, at in parts((h % U64(self.coarse)).astype(np.int64)):
            rows.append((k, flush, ((h[at] >> U64(32)).astype("<u4") if short else h[at]).tobytes(), o[at].tobytes(), b"", m[at].tobytes() if m is not None else b""))
        return sent(rows)

    def answered(self, sent_rows: DataFrame) -> DataFrame:
        """Rows of SENT whose key is the flush: its own, and answers (a: ordinals, and with totals d: their sums)."""
        if self.coarse == self.buckets:
            return self.wide(sent_rows).groupBy("bucket").applyInArrow(lambda key, table: self._find(key, table), SENT)
        group = F.pmod(F.xxhash64("flush"), F.lit(self.coarse))
        met = sent_rows.withColumn("group", group).groupBy("bucket", "group").applyInArrow(lambda key, table: self._gather(key, table), SENT)
        return self.wide(met).groupBy("bucket").applyInArrow(lambda key, table: self._find(key, table), SENT).groupBy("bucket", "flush").applyInArrow(lambda key, table: self._home(key, table), SENT)

    def wide(self, rows: DataFrame) -> DataFrame:
        """As many tasks as the buckets ask for, where the session's setting is far below them."""
        usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(self.buckets // 4, "bucket") if self.buckets > 16 * usual else rows

    @staticmethod
    def _entries(table) -> tuple:
        """hashes, ordinals, flushes, and what else was sent, of all rows."""
        a, b, c, d = (table.column(x).to_pylist() for x in "abcd")
        n = [len(x) // 4 for x in b]
        kind = "<u4" if len(a[0]) == len(b[0]) else "<u8"
        flush = np.frombuffer(b"".join(c), "<i8") if c[0] else np.repeat(table.column("flush").to_numpy(), n)
        return np.frombuffer(b"".join(a), kind), np.frombuffer(b"".join(b), "<u4"), flush, np.frombuffer(b"".join(d), "<u8") if d[0] else None

    def _gather(self, key, table):
        """Of some flushes in a coarse bucket: rows for its fine buckets, and what is already known to repeat."""
        if key[0].as_py() < 0:
            return table.drop_columns(["group"])
        h, o, flush, more = self._entries(table)
        out = []
        if not self.totals:
            one, twice = collapse(h, more)
            for f, at in parts(np.where(twice, flush, -1)):
                if f >= 0:
                    out.append((flush_key(f), f, o[at].tobytes(), None, None, None))
            h, o, flush, more = h[one], o[one], flush[one], more[one] if more is not None else None
        for k, at in parts((h % U64(self.buckets)).astype(np.int64)):
            out.append((k, key[1].as_py(), h[at].tobytes(), o[at].tobytes(), flush[at].astype("<i8").tobytes(), more[at].tobytes() if more is not None else b""))
        return pa.Table.from_batches([sent(out)])

    def _find(self, key, table):
        if key[0].as_py() < 0:
            return table
        h, o, flush, more = self._entries(table)
        two = self.coarse != self.buckets
        if self.totals:
            words, at = np.unique(h, return_inverse=True)
            sums = np.zeros(len(words), np.uint64)
            np.add.at(sums, at, more)
            pick, value = np.arange(len(h)), sums[at]
        else:
            pick, value = np.flatnonzero(collapse(h, more)[1]), None
        group = np.repeat(table.column("flush").to_numpy(), [len(x) // 4 for x in table.column("b").to_pylist()])
        out = [(SUMMARY, key[0].as_py(), *self.summary(words, sums))] if self.summary else []
        for g, at in parts(group[pick]):
            at = pick[at]
            back = key[0].as_py() % self.coarse if two else flush_key(g)
            out.append((back, g, o[at].tobytes(), None, flush[at].astype("<i8").tobytes() if two else None, value[at].astype("<u8").tobytes() if value is not None else None))
        return pa.Table.from_batches([sent(out)])

    def _home(self, key, table):
        """Answers for some flushes: a row for each."""
        if key[0].as_py() < 0:
            return table
        o, flush = (np.frombuffer(b"".join(table.column(x).to_pylist()), kind) for x, kind in (("a", "<u4"), ("c", "<i8")))
        value = np.frombuffer(b"".join(x or b"" for x in table.column("d").to_pylist()), "<u8")
        out = [(flush_key(f), f, o[at].tobytes(), None, None, value[at].tobytes() if self.totals else None) for f, at in parts(flush)]
        return pa.Table.from_batches([sent(out)])

    def repeats(self, sent_rows: DataFrame, per_flush, schema: str) -> DataFrame:
        """Back to the flushes: per_flush(their own data, ordinals that repeat) -> rows of the schema."""

        def back(key, table):
            own, marks = None, []
            for a, b, c, d in zip(*(table.column(x).to_pylist() for x in "abcd"), strict=True):
                marks.append(np.frombuffer(a, "<u4"))
                if b is not None:
                    own = (b, c, d)
            return per_flush(own, np.unique(np.concatenate(marks)))

        return self.answered(sent_rows).groupBy("flush").applyInArrow(back, schema)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive integers as ranges: their first and last values."""
    if not len(sorted_values):
        return sorted_values, sorted_values
    cut = np.flatnonzero(np.diff(sorted_values) != 1)
    return sorted_values[np.r_[0, cut + 1]], sorted_values[np.r_[cut, len(sorted_values) - 1]]


RANGES = f"{KEY} binary, ranges binary"


def doc_ranges(keys: np.ndarray, starts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
    """Ranges [lo, hi) in a flush's coordinates as one row per document, in the document's. No range spans documents."""
    doc = np.searchsorted(starts, lo, side="right") - 1
    flat = np.stack([lo - starts[doc], hi - starts[doc]], 1).astype("<i8")
    order = np.argsort(doc, kind="stable")
    doc, flat = doc[order], flat[order]
    which, at = np.unique(doc, return_index=True)
    ends = np.r_[at[1:], len(doc)][: len(at)]
    return pa.table({KEY: pa.array(keys[which].tolist(), pa.binary()), "ranges": pa.array([flat[i:j].tobytes() for i, j in zip(at, ends, strict=True)], pa.binary())})


def one_per_key(ranges: DataFrame) -> DataFrame:
    """Rows that are equal share a key and have equal ranges: keep one, that a join doesn't multiply rows."""
    return ranges.groupBy(KEY).agg(F.max("ranges").alias("ranges"))
