"""Token id files: one id array per file, with Elias-Fano coded document boundaries.

Layout of a file (little-endian): the ids of all its documents (16 bits each if the vocabulary allows, else 32), then
the sections, then a footer of 13 unsigned 64-bit numbers:
magic, documents, ids, bytes per id, documents whose doc_id is null (first), least doc_id, and for boundaries and for
doc_ids in turn the low bits per value and the section's place, and the footer's own place.
A section has the packed low bits, the high bits in unary, and the select samples: the place in the high bits of
every 256th one, as 32-bit numbers. Offsets come from a sample and a count over a few bytes; no 64-bit table is kept.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outbreak_spark.llm.common import Workspace, text_bytes
from outbreak_spark.llm.tokens import shared_encoder, text_groups

MAGIC = 0x31464554_4B4F5431
SAMPLE = 256
#: Text bytes of a file: as a rule, and the least for which small tables are split further.
SHARD_BYTES, LEAST_BYTES = 256 << 20, 4 << 20


class EliasFano:
    """A non-decreasing sequence of non-negative integers in about 2 + log2(last / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, int(values[-1]) // n).bit_length() - 1 if n and int(values[-1]) >= n else 0
        low, step = [np.empty(0, np.uint8)], 1 << 14  # a block's bits are whole bytes
        for k in range(0, n if bits else 0, step):
            part = (values[k : k + step, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            low.append(np.packbits(part.astype(np.uint8).ravel(), bitorder="little"))
        low = np.concatenate(low)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 8) // 8 if n else 0, np.uint8)
        for k in range(0, n, step):
            np.bitwise_or.at(high, ones[k : k + step] >> 3, (1 << (ones[k : k + step] & 7)).astype(np.uint8))
        return cls(n, bits, low, high, ones[::SAMPLE].astype("<u4"))

    def select(self, k: int) -> int:
        """Place of the k-th one in the high bits."""
        at, left = int(self.samples[k // SAMPLE]), k % SAMPLE
        byte, skip = at >> 3, at & 7
        while True:
            chunk = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
            chunk[:skip] = 0
            ones = np.flatnonzero(chunk)
            if left < len(ones):
                return 8 * byte + int(ones[left])
            left, byte, skip = left - len(ones), byte + 64, 0

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.n:
            raise IndexError(k)
        value = (self.select(k) - k) << self.low_bits
        lo = k * self.low_bits
        bits = np.unpackbits(self.low[lo // 8 : (lo + self.low_bits + 7) // 8], bitorder="little")[lo % 8 : lo % 8 + self.low_bits]
        return value | sum(int(b) << i for i, b in enumerate(bits))

    def block(self, lo: int, hi: int) -> np.ndarray:
        """Values lo .. hi - 1, decoded together from one select."""
        if lo >= hi:
            return np.empty(0, np.uint64)
        begin, end = self.select(lo), self.select(hi - 1)
        ones = np.flatnonzero(np.unpackbits(self.high[begin >> 3 : (end >> 3) + 1], bitorder="little")) + 8 * (begin >> 3)
        ones = ones[(ones >= begin) & (ones <= end)]
        values = (ones - np.arange(lo, hi)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            a, b = lo * self.low_bits, hi * self.low_bits
            bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].reshape(-1, self.low_bits)
            values |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return values

    def tobytes(self) -> bytes:
        sizes = np.array([self.n, len(self.low), len(self.high)], "<u8").tobytes()
        return sizes + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: bytes, low_bits: int) -> EliasFano:
        n, low, high = (int(x) for x in np.frombuffer(data, "<u8", 3))
        raw = np.frombuffer(data, np.uint8, offset=24)
        return cls(n, low_bits, raw[:low], raw[low : low + high], np.frombuffer(data, "<u4", (n + SAMPLE - 1) // SAMPLE, 24 + low + high))


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


class TokenFile:
    """Reads a file: document k has ids bounds[k] .. bounds[k + 1] - 1."""

    def __init__(self, path: str):
        where, path = _open(path)
        self.file = where.open_input_file(path)
        end = self.file.size()
        foot = [int(x) for x in np.frombuffer(self.file.read_at(8 * 13, end - 8 * 13), "<u8")]
        if foot[0] != MAGIC:
            raise ValueError("not a token file")
        _, self.documents, self.ids, self.width, self.nulls, _, low1, at1, low2, at2, own, _, _ = foot
        self.least = int(np.array(foot[5], np.uint64).astype(np.int64))
        self.bounds = EliasFano.read(self.file.read_at(at2 - at1, at1), low1)
        self.names = EliasFano.read(self.file.read_at(own - at2, at2), low2)

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((hi - lo) * self.width, lo * self.width), f"<u{self.width}")

    def doc_ids(self, lo: int, hi: int) -> list[int | None]:
        """doc_ids of documents lo .. hi - 1."""
        known = self.names.block(max(0, lo - self.nulls), max(0, hi - self.nulls))
        return [None] * max(0, min(hi, self.nulls) - lo) + (known + np.uint64(self.least & (2**64 - 1))).astype(np.int64).tolist()


WRITTEN = "shard int, path string, documents long, ids long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Writes whole texts' ids, each followed by end_id, in ascending doc_id order (null first, ties by text).

    docs needs doc_id and text; other columns are ignored; null text is empty; repeated rows are written again.
    Returns a row per file: shard (files in doc_id order), path, documents, ids; an empty table has none. Each attempt
    writes a file of its own name, so run it once, into a table: only files named there count. shards: number of files,
    by default one for SHARD_BYTES of text, more only as long as all tasks have work. Bounds of files are by doc_id and the
    text's beginning, so that a doc_id of many rows needn't be one file.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if not shards:
        total, usual = text_bytes(docs), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shards = max(1, -(-total // SHARD_BYTES), min(usual, -(-total // LEAST_BYTES)))
    rows = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches):
        encoder, shard = shared_encoder(tokenizer), TaskContext.get().partitionId()
        width = 2 if max(encoder.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
        sink, path, names, lengths, nulls = None, f"{folder}/tokens-{shard:06d}-{uuid.uuid4().hex[:8]}.bin", [], [], 0
        for batch in batches:
            if sink is None:
                where, local = _open(path)
                where.create_dir(local.rpartition("/")[0], recursive=True)
                sink = where.open_output_stream(local)
            own = batch.column("doc_id")
            nulls += own.null_count
            names.append(own.drop_null().to_numpy())
            for _, _, texts in text_groups(batch.column("text")):
                ids, count = encoder.ids(texts)
                lengths.append(count + 1)
                sink.write(np.insert(ids, np.cumsum(count), end_id).astype(f"<u{width}").tobytes())
        if sink is None:
            return
        bounds, names = np.r_[0, np.cumsum(np.concatenate(lengths))], np.concatenate(names)
        least = int(names[0]) if len(names) else 0
        one, two = EliasFano.of(bounds), EliasFano.of(names.astype(np.uint64) - np.array(least, np.int64).astype(np.uint64))
        at1 = int(bounds[-1]) * width
        at2 = at1 + len(one.tobytes())
        own = at2 + len(two.tobytes())
        foot = [MAGIC, len(bounds) - 1, int(bounds[-1]), width, nulls, least & (2**64 - 1), one.low_bits, at1, two.low_bits, at2, own, 0, 0]
        sink.write(one.tobytes() + two.tobytes() + np.array(foot, np.uint64).astype("<u8").tobytes())
        sink.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "documents": [len(bounds) - 1], "ids": [int(bounds[-1])]})

    return rows.mapInArrow(write, WRITTEN)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_tokens(files: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), decoded in blocks of about so many ids."""
    spark, before, rows = files.sparkSession, 0, []
    for f in sorted(files.collect(), key=lambda f: f.shard):  # a row per file
        rows.append((f.path, before))
        before += f.ids

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                file = TokenFile(path)
                for lo in range(0, file.documents, 4096):
                    hi = min(lo + 4096, file.documents)
                    bounds = file.bounds.block(lo, hi + 1).astype(np.int64)
                    crc, k, have = [], 0, np.empty(0, "<u4")
                    while k < hi - lo:
                        begin = int(bounds[k])
                        last = max(k + 1, int(np.searchsorted(bounds, begin + block, side="right")) - 1)
                        if last == k + 1:  # perhaps a very long document
                            c = 0
                            for at in range(begin, int(bounds[last]), block):
                                c = zlib.crc32(file.tokens(at, min(at + block, int(bounds[last]))).astype("<u4").tobytes(), c)
                            crc.append(c)
                        else:
                            have = memoryview(file.tokens(begin, int(bounds[last])).astype("<u4").tobytes())
                            crc += [zlib.crc32(have[4 * (a - begin) : 4 * (b - begin)]) for a, b in zip(bounds[k:last].tolist(), bounds[k + 1 : last + 1].tolist(), strict=True)]
                        k = last
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (file.doc_ids(lo, hi), base + bounds[:-1], np.diff(bounds), crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(rows, "path string, base long")
    return table.repartition(max(1, len(rows))).mapInArrow(read, READ)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    work = Workspace(spark, "tokens")
    files = work.write(write_tokens(docs, work.path("files"), public_tokenizers.path("word_bpe_49k.json"), end_id=2), "written")
    return read_tokens(files)
