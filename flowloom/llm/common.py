"""What the operators of this subpackage share: a written table in the cluster's
shared folder, and array helpers for tasks that work on whole Arrow batches."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a new temporary one only where it is unset and all tasks run on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flowloom-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that later steps survive lost executors
    without running its plan again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, name: str) -> None:
    """Deletes what was written under a name of the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, or with underscores before it, so that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def short_batches(spark: SparkSession, size: str = "4m") -> None:
    """Has Arrow batches end at about `size`, unless the session sets a size itself. By rows alone a batch holds
    10,000 texts, of which the executor and its Python worker keep several copies beside the heap."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, size)


def texts(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about `limit` UTF-8 bytes.

    A row is never split, so a longer row makes a run of its own. Null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3, on an unsigned array."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


#: Bytes up to which of_words() mixes a string piece by piece, and masks of the lowest 0 to 8 bytes.
LONG = 256
LOWEST = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


class Rolling:
    """Hashes of substrings. Equal strings have equal hashes wherever they stand.

    hashes() takes them from one prefix sum, sum(R[byte] * P**position) * P**-start mod 2**64, for any number of short substrings
    that overlap; modulo a power of two, some pairs of 1024 bytes and more have equal sums for every P. of_words() is for whole words.
    """

    def __init__(self, seed: int = 1):
        self.of_byte = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
        self.base = 0xD6E8FEB86659FD93 | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, x, U64)])) for x in (self.base, self.inverse))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.powers(len(data) + 1)
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.of_byte[data] * self.up[: len(data)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])

    def of_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of substrings, whose bytes are mixed in eight at a time; those of over LONG bytes are first digested. Unlike a
        prefix sum, this has no pairs of strings that collide whatever the seed."""
        size = end - start
        out = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + self.of_byte[0])
        eight = np.ndarray(len(data) + 1, U64, np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
        live, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
        while len(live):
            piece = eight[start[live] + at] & LOWEST[np.minimum(size[live] - at, 8)]
            out[live] = mix(out[live] ^ piece)
            at += 8
            live = live[size[live] > at]
        for i in np.flatnonzero(size > LONG):
            digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest()
            out[i : i + 1] = mix(out[i : i + 1] ^ np.frombuffer(digest, U64))
        return out


def byte_set(keep: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 booleans from inclusive ranges."""
    table = np.zeros(256, bool)
    for lo, hi in keep:
        table[lo : hi + 1] = True
    return table


#: A-Z to a-z, every other byte as it is; UTF-8 sequences hold no ASCII bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]
NOT_SPACE = ~byte_set([(0x20, 0x20), (0x09, 0x0D)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALNUM = ~byte_set([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words up to each row's end from 0) of the maximal runs of word bytes; none crosses rows."""
    inside = is_word[data]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        before[cuts] = False
    start = np.flatnonzero(inside & ~before)
    stop = np.ones(len(inside) + 1, bool)
    stop[: len(inside)] = ~inside | ~before
    stop[len(inside)] = True
    ends = np.flatnonzero(stop)
    end = ends[np.searchsorted(ends, start, "right")] if len(start) else start
    return start, end, np.searchsorted(start, offsets)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit values as first differences, without the bytes that all lack."""
    steps = np.diff(values, prepend=U64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, :width] = raw
    return np.cumsum(steps.view(U64).ravel(), dtype=U64)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers, without the bytes that all lack."""
    values = np.asarray(values, U64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, blob[0])
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : blob[0]] = raw
    return out.view(U64).ravel()


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of one key at a time, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[0].column(key)[0].as_py() != keys[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def pack_counts(values: np.ndarray) -> bytes:
    """Counts as a byte each, and those of 255 or more once again in full."""
    values = np.asarray(values, U64)
    large = values[values >= 255]
    return np.minimum(values, U64(255)).astype(np.uint8).tobytes() + (pack(large) if len(large) else b"")


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(blob, np.uint8, n).astype(U64)
    if len(blob) > n:
        out[out == 255] = unpack(blob[n:])
    return out


def released(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps now rather than at some later collection of the
    driver's garbage; what one collection finds unreachable is let go of by the next. Arrow gives back what it holds in reserve."""
    for _ in range(3):
        gc.collect()
        pa.default_memory_pool().release_unused()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
