"""Capture files and the UDP datagrams in them."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import exprs as X
from flowloom.schemas import FRAMES

#: Fixed values of the format: magic numbers as (byte order, nanoseconds a fraction unit), and link types.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("little", 1000), b"\xa1\xb2\xc3\xd4": ("big", 1000), b"\x4d\x3c\xb2\xa1": ("little", 1), b"\xa1\xb2\x3c\x4d": ("big", 1)}
ETHERNET, RAW, RAW_ALT, NULL, LOOP, SLL, SLL2 = 1, 101, 12, 0, 108, 113, 276
MOST_FRAME, HEAD, RECORD = 1 << 24, 24, 16


class Capture:
    """An open capture file, read by pieces."""

    def __init__(self, uri: str, piece: int = 1 << 22):
        fs, at = pafs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")
        self.file, self.piece = fs.open_input_file(at), piece
        self.size, self.begin, self.held = self.file.size(), 0, b""
        head = self.bytes(0, HEAD)
        if head[:4] not in MAGIC:
            raise ValueError(f"not a capture file: {head[:4].hex()}")
        self.order, self.unit = MAGIC[head[:4]]
        self.link = int.from_bytes(head[20:24], self.order)

    def bytes(self, at: int, n: int) -> bytes:
        if not (self.begin <= at and at + n <= self.begin + len(self.held)):
            self.file.seek(at)
            self.begin, self.held = at, self.file.read(max(n, self.piece))
        return self.held[at - self.begin : at - self.begin + n]

    def record(self, at: int) -> tuple[int, int, int, int] | None:
        """(seconds, fraction, captured length, original length) of the record at a place; None where the file ends within it."""
        head = self.bytes(at, RECORD)
        if len(head) < RECORD:
            return None
        found = struct.unpack("<IIII" if self.order == "little" else ">IIII", head)
        if found[2] > MOST_FRAME:
            raise ValueError(f"implausible frame length {found[2]}")
        return found if at + RECORD + found[2] <= self.size else None

    def records(self, start: int, stop: int) -> Iterator[tuple[int, tuple[int, int, int, int]]]:
        """(place, header) of the records that begin from `start` to before `stop`; a cut-off last one is left out."""
        while start < stop and (head := self.record(start)):
            yield start, head
            start += RECORD + head[2]

    def likely_start(self, at: int, stop: int, chain: int = 8) -> int:
        """The first place from `at` on from where `chain` headers in a row, or all up to the file's end, look like ones, of about the
        time of the first frame; `stop` if there is none before it. A guess: see pieces()."""
        limit, near = 10**9 if self.unit == 1 else 10**6, 10 * 366 * 86400
        form = "<IIII" if self.order == "little" else ">IIII"
        first = struct.unpack(form, self.bytes(HEAD, RECORD))[0] if self.size >= HEAD + RECORD else 0
        while at < stop:
            here, links = at, 0
            while links < chain and here < self.size:
                head = self.bytes(here, RECORD)
                if len(head) < RECORD:
                    break
                seconds, fraction, size, whole = struct.unpack(form, head)
                if abs(seconds - first) > near or fraction >= limit or not size <= min(whole, MOST_FRAME):
                    break
                here, links = here + RECORD + size, links + 1
            if links == chain or here == self.size:
                return at
            at += 1
        return stop


def probe(piece: tuple[str, int, int, int, int]) -> tuple[str, int, int, int, int]:
    """(file, piece, first record, where the records end, records) of (file, piece, low, high, first record or -1 for a guess). A
    guess that leads to a header that can't be one ends there."""
    name, nth, lo, hi, known = piece
    capture = Capture(name)
    start = known if known >= 0 else capture.likely_start(lo, hi)
    stop, n = start, 0
    try:
        for at, head in capture.records(start, hi):
            stop, n = at + RECORD + head[2], n + 1
    except ValueError:
        if known >= 0:
            raise
    return name, nth, start, stop, n


def pieces(spark: SparkSession, glob: str, piece_bytes: int) -> list[tuple[str, int, int, int]]:
    """(file, first record, end, number of the first frame) of pieces of about piece_bytes.

    Tasks guess where their pieces' first records are and walk the headers from there; where a guess isn't where the
    piece before ends, the piece is walked again from there. So the pieces are those of a walk through the whole file, whatever the
    frames hold. What comes to the driver is a row for each piece.
    """
    files = [(r["path"], r["length"]) for r in spark.read.format("binaryFile").load(glob).select("path", "length").collect()]
    cuts = {name: list(zip([HEAD, *range(max(piece_bytes, HEAD + 1), size, piece_bytes)], [*range(max(piece_bytes, HEAD + 1), size, piece_bytes), size])) for name, size in files}
    found: dict[tuple[str, int], tuple] = {(name, 0): (HEAD, size, -1) for name, size in files if len(cuts[name]) == 1}
    todo = [(name, i, lo, hi, -1 if i else HEAD) for name, c in cuts.items() if len(c) > 1 for i, (lo, hi) in enumerate(c)]

    def walk(batches):
        for batch in batches:
            done = [probe(tuple(r.values())) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done]) for i in range(5)], ["file", "nth", "start", "stop", "n"])

    while True:
        if todo:
            rows = spark.createDataFrame(todo, "file string, nth long, lo long, hi long, start long").repartition(len(todo))
            for r in rows.mapInArrow(walk, "file string, nth long, start long, stop long, n long").collect():
                found[r["file"], r["nth"]] = (r["start"], r["stop"], r["n"])
        todo, out = [], []
        for name, c in cuts.items():
            expected, frames = HEAD, 0
            for i, (_, hi) in enumerate(c):
                if expected >= hi:
                    continue  # within one long record
                start, stop, n = found[name, i]
                if start != expected:
                    todo.append((name, i, expected, hi, expected))
                    break
                if n:
                    out.append((name, start, stop, frames))
                if n >= 0 and stop < hi:
                    break  # the file ends within a record
                expected, frames = stop, frames + n
        if not todo:
            return out


def read_pcap(spark: SparkSession, glob: str, piece_bytes: int = 64 << 20) -> DataFrame:
    """Frames of capture files of any size, a task for each piece of about piece_bytes; the pieces are found when this is called.

    A last frame that is cut off is left out. A file that is no capture, or has a frame of an implausible length, raises.
    Tasks read through pyarrow's file systems.
    """
    parts = pieces(spark, glob, piece_bytes)
    if not parts:
        return spark.createDataFrame([], FRAMES)
    rows = spark.createDataFrame(parts, "file string, start long, stop long, first long").repartition(len(parts))

    def read(batches):
        names = ["file", "seq", "ts", "orig_len", "link_type", "data"]
        kinds = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for part in batch.to_pylist():
                capture, out, held = Capture(part["file"]), [], 0
                for n, (at, (s, fraction, size, whole)) in enumerate(capture.records(part["start"], part["stop"])):
                    out.append((part["file"], part["first"] + n, s * 10**6 + fraction * capture.unit // 1000, whole, capture.link, capture.bytes(at + RECORD, size)))
                    held += size
                    if held > 1 << 22 or len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(read, FRAMES)


def write_pcap(frames: DataFrame, base: str) -> DataFrame:
    """Writes frames as captures below `base`, in files by source file and link type, which a capture has one of; returns (path, frames).

    Little-endian, microseconds. Each file is written under a temporary name and then moved.
    """
    rows = frames.repartition("file", "link_type").sortWithinPartitions("file", "link_type", "seq").select("file", "link_type", "ts", "orig_len", "data")

    def write(batches):
        fs, at = pafs.FileSystem.from_uri(base if ":" in base.split("/")[0] else f"file://{base}")
        fs.create_dir(at, recursive=True)
        done, now, out, name, n = [], None, None, "", 0

        def close():
            if out is not None:
                out.close()
                fs.move(f"{at}/.tmp-{name}", f"{at}/{name}")
                done.append((f"{at}/{name}", n))

        for batch in batches:
            micros = batch.column("ts").cast(pa.int64()).to_pylist()
            for file, link, us, whole, data in zip(batch.column("file").to_pylist(), batch.column("link_type").to_pylist(), micros, batch.column("orig_len").to_pylist(), batch.column("data").to_pylist()):
                if (file, link) != now:
                    close()
                    now, n = (file, link), 0
                    name = f"{hashlib.sha256(file.encode()).hexdigest()[:16]}-{link}.pcap"
                    out = fs.open_output_stream(f"{at}/.tmp-{name}", compression=None)
                    out.write(struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 18, link))
                out.write(struct.pack("<IIII", us // 10**6, us % 10**6, len(data), max(whole, len(data))) + data)
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "frames"])

    written = rows.mapInArrow(write, "path string, frames long")
    return frames.sparkSession.createDataFrame(written.collect(), written.schema)  # a row for each file; the plan runs once


def l3_offset(link: Column, data: Column, tags: int = 8) -> Column:
    """Where the IPv4 header starts; null for frames that aren't IPv4. Up to `tags` stacked VLAN tags."""
    kind = lambda at: X.field(data, at, 2)
    step = lambda at, _: F.when(kind(at - 2).isin(0x8100, 0x88A8), at + 4).otherwise(at)
    ethernet = F.aggregate(F.sequence(F.lit(1), F.lit(tags)), F.lit(14), step)
    return (
        F.when((link == ETHERNET) & (F.length(data) >= ethernet) & (kind(ethernet - 2) == 0x0800), ethernet)
        .when(link.isin(RAW, RAW_ALT), F.lit(0))
        .when((link == SLL) & (kind(F.lit(14)) == 0x0800), F.lit(16))
        .when((link == SLL2) & (kind(F.lit(0)) == 0x0800), F.lit(20))
        .when(link.isin(NULL, LOOP), F.lit(4))
    )


def with_layers(frames: DataFrame) -> DataFrame:
    """IPv4 frames with l3, where that header starts, `after`, where it ends, and udp: `after` where there is a whole UDP header, else null;
    and payload_len of the UDP payload, which ends where the frame does if that cut it short."""
    d = F.col("data")
    rows = frames.withColumn("l3", l3_offset(F.col("link_type"), d)).filter(F.col("l3").isNotNull() & (F.length(d) >= F.col("l3") + 20))
    first = X.field(d, F.col("l3"), 1)
    rows = rows.withColumn("after", F.when(F.floor(first / 16) == 4, F.col("l3") + (first % 16 * 4).cast("int"))).filter((F.col("after") >= F.col("l3") + 20) & (F.length(d) >= F.col("after")))
    rows = rows.withColumn("udp", F.when((F.length(d) >= F.col("after") + 8) & (X.field(d, F.col("l3") + 9, 1) == 17), F.col("after")))
    rest = F.length(d) - F.col("udp") - 8
    said = X.field(d, F.col("udp") + 4, 2).cast("int") - 8
    return rows.withColumn("payload_len", F.when((said < 0) | (said > rest), rest).otherwise(said))


def extract_udp(frames: DataFrame) -> DataFrame:
    """(datagram_id, recv_ts, exporter_ip, port, payload, src_port, dst_port) of the IPv4/UDP frames.

    A payload that the capture cut short ends where the frame does.
    """
    d = F.col("data")
    return with_layers(frames).filter(F.col("udp").isNotNull()).select(
        F.xxhash64("file", "seq").alias("datagram_id"), F.col("ts").alias("recv_ts"), X.field(d, F.col("l3") + 12, 4).alias("exporter_ip"), X.field(d, F.col("udp") + 2, 2).cast("int").alias("port"),
        F.substring(d, F.col("udp") + 9, F.col("payload_len")).alias("payload"), X.field(d, F.col("udp"), 2).cast("int").alias("src_port"), X.field(d, F.col("udp") + 2, 2).cast("int").alias("dst_port"),
    )
