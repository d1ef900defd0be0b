"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by key; the ranges come from exact sums of payload
bytes, so they depend on the rows alone, not on a sample or the number of
partitions. Each range rolls its files by compressed size. A file is written
under a temporary name, then moved to its own, which comes from the first key
it holds; last, a manifest lists the files that belong to the archive. A task
that runs again writes the same bytes under the same names, and files that no
manifest lists are never read.

Tasks write through pyarrow's file systems, so the folder may be any that it
opens by URI (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_partitions

ROLL_BYTES = 16 << 20
#: Payload bytes of a range, about, and cells in which they are summed up at a time.
RANGE_BYTES, CELLS = 64 << 20, 1 << 16
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def one_line(text: str) -> str:
    """A header value without line breaks, which would end the header."""
    return "".join(c for c in text if c not in "\r\n")


def record_id(key: int | None, digest: str, nth: int) -> str:
    """The id of the nth record with this key and payload digest, from 0."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{key}/{nth}/{digest}'.encode()).digest()[:16], version=5)}>"


def record(key: int | None, nth: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, whole, with headers made anew. A revisit has no payload but its digest and length."""
    kind = "response" if refers_to is None else "revisit"
    digest = base32_sha1(payload)
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        body += payload
    head = [
        VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key, digest, nth)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line(url or '')}",
        f"WARC-Block-Digest: sha1:{base32_sha1(body)}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest, 0)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"X-Page-ID: {'' if key is None else key}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class Roller:
    """Writes gzip members to one file after another, each moved to its name when it is whole."""

    def __init__(self, base: str, roll_bytes: int):
        self.fs, self.at = open_fs(base)
        self.roll_bytes, self.out = roll_bytes, None

    def add(self, name: str, data: bytes) -> Iterator[dict]:
        """Writes one member; `name` is what a file is called that starts with it."""
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(data) + z.flush()
        if self.out is not None and self.size + len(member) > self.roll_bytes:
            yield from self.close()
        if self.out is None:
            self.name, self.size, self.count, self.sha = f"{name}.warc.gz", 0, 0, hashlib.sha256()
            self.tmp = f"{self.at}/.tmp-{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.tmp, compression=None)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.count += 1

    def close(self) -> Iterator[dict]:
        if self.out is not None:
            self.out.close()
            at = f"{self.at}/{self.name}"
            if self.fs.get_file_info(at).type != pafs.FileType.NotFound:  # from a task that was lost; the same bytes
                self.fs.delete_file(at)
            self.fs.move(self.tmp, at)
            self.out = None
            yield {"file": self.name, "records": self.count, "bytes": self.size, "sha256": self.sha.hexdigest()}


def exact_cuts(sizes: DataFrame, key: str, size: str, target: int, cells: int = CELLS) -> list[int]:
    """Ascending keys at which ranges of about `target` bytes start, the first left out; null keys don't count.

    Keys are dealt to cells by their leading bits and their sizes summed up; a cell with more than the target is cut again by at
    least one bit more, down to single keys. What comes to the driver are `cells` sums at a time, or two for each cell over
    the target, which are fewer than ranges.
    """
    flip, every = -(1 << 63), (1 << 64) - 1  # keys without a sign, in the same order
    sizes = sizes.filter(F.col(key).isNotNull()).select(key, size, F.col(key).bitwiseXOR(F.lit(flip)).alias("__bits"))
    ends = sizes.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if ends["lo"] is None:
        return []
    found: list[tuple[int, int]] = []  # (first key, bytes) of cells that need no more cutting
    shift = max(0, ((int(ends["lo"]) ^ int(ends["hi"])) & every).bit_length() - cells.bit_length() + 1)
    while True:
        cut = sizes.groupBy(F.shiftrightunsigned("__bits", shift).alias("cell")).agg(F.sum(size).alias("bytes"), F.min(key).alias("first")).toArrow()
        first, n = cut["first"].to_numpy(), cut["bytes"].to_numpy()
        heavy = (n > target) & (shift > 0)
        found += zip(first[~heavy].tolist(), n[~heavy].tolist())
        if not heavy.any():
            break
        wide = sizes.sparkSession.createDataFrame(pa.table({"__cell": cut["cell"].filter(pa.array(heavy))}))
        sizes = sizes.join(wide, F.shiftrightunsigned("__bits", shift) == F.col("__cell"), "left_semi")
        shift = max(0, shift - max(1, (cells // int(heavy.sum())).bit_length() - 1))
    cuts, held = [], 0
    for first, n in sorted(found):
        if held and held + n > target:
            cuts.append(first)
            held = 0
        held += n
    return cuts


def write_archive(pages: DataFrame, base: str, min_revisit_bytes: int = 0, roll_bytes: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes (page_id, url, html) rows as WARC files below `base`; returns the manifest that it leaves there.

    The payload is html in UTF-8; null counts as empty. Of equal payloads of at least min_revisit_bytes
    the one with the smallest page_id is the response, the others revisit it; smaller ones are all
    responses. Rows that repeat a page_id are records of their own: of equal ones the first is the
    response. Rows with a null page_id come last, dealt by digest; they revisit an equal payload that has an id, and are
    responses otherwise. An empty table makes an empty manifest.
    """
    spark = pages.sparkSession
    fs, at = open_fs(base)
    fs.create_dir(at, recursive=True)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    light = pages.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").cast("long").alias("size"))
    sizes = light.select("page_id", (F.col("size") + 512).alias("bytes"))
    cuts = exact_cuts(sizes, "page_id", "bytes", range_bytes)
    last = sizes.filter("page_id IS NULL").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    others = max(1, -(-last // range_bytes))
    light = light.filter(F.col("size") >= min_revisit_bytes)
    shared = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    roles = light.join(shared, "digest").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "first").distinct()
    both = pages.withColumns({"digest": F.sha1("payload"), "first": F.lit(None).cast("long")}).unionByName(roles)

    def ranged(batches):
        edges = np.array(cuts, np.int64)
        for batch in batches:
            keys = batch.column("page_id")
            part = np.searchsorted(edges, keys.fill_null(0).to_numpy(zero_copy_only=False), "right")
            for i in np.flatnonzero(keys.is_null().to_numpy(zero_copy_only=False)):
                part[i] = len(cuts) + 1 + int(batch.column("digest")[i].as_py()[:15], 16) % others
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *batch.columns], ["part", *batch.schema.names])

    ranges = both.mapInArrow(ranged, "part int, page_id long, url string, payload binary, digest string, first long")
    sorted_rows = ranges.repartition(max(shuffle_partitions(spark), len(cuts) + 1), "part").sortWithinPartitions("part", "page_id", "digest", F.asc_nulls_last("first"), "url")
    # Roles come before their rows: nulls in `first` sort last.

    def write(batches):
        out, role, seen, nth, last = Roller(base, roll_bytes), None, {}, 0, None
        rows: list[dict] = []
        for batch in batches:
            for part, key, url, payload, digest, first in zip(*(batch.column(c).to_pylist() for c in ("part", "page_id", "url", "payload", "digest", "first"))):
                if last is None or part != last[0]:
                    rows += out.close()
                if first is not None:
                    role = (key, digest, first)
                    continue
                if (part, key) != last:
                    seen, nth, last = {}, 0, (part, key)
                before = seen.get(digest, 0)
                refers = role[2] if role and role[:2] == (key, digest) and (role[2] != key or before) else None
                seen[digest] = before + 1
                name = f"none-{digest}-{nth:06d}" if key is None else f"part-{key + 2**63:020d}-{nth:06d}"
                rows += out.add(name, record(key, before, url, payload, refers))
                nth += 1
        rows += out.close()
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    manifest = sorted_rows.mapInArrow(write, "file string, records long, bytes long, sha256 string")
    manifest.write.parquet(f"{base}/manifest")
    for left in fs.get_file_info(pafs.FileSelector(at)):  # from tasks that were lost
        if left.base_name.startswith(".tmp-"):
            fs.delete_file(left.path)
    return spark.read.parquet(f"{base}/manifest")


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, whole, one by one."""
    z, parts = zlib.decompressobj(31), []
    while data := stream.read(size):
        while data:
            parts.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record; raises if its length or a digest doesn't hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(headers["Content-Length"])
    block = rest[:n]
    if lines[0] != VERSION or len(block) != n or f"sha1:{base32_sha1(block)}" != headers["WARC-Block-Digest"]:
        raise ValueError("a damaged record")
    return headers, block


def read_archive(spark: SparkSession, base: str) -> DataFrame:
    """(page_id, record_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every record of the
    files that the manifest lists; digests of responses are taken anew from what was read."""
    manifest = spark.read.parquet(f"{base}/manifest").select("file")
    schema = "page_id long, record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    fields = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches):
        fs, at = open_fs(base)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    for data in members(stream):
                        h, block = parse(data)
                        kind, payload = h["WARC-Type"], block.partition(b"\r\n\r\n")[2]
                        digest = base32_sha1(payload) if kind == "response" else h["WARC-Payload-Digest"][5:]
                        if f"sha1:{digest}" != h["WARC-Payload-Digest"]:
                            raise ValueError("a payload differs from its digest")
                        rows.append({
                            "page_id": int(h["X-Page-ID"]) if h["X-Page-ID"] else None, "record_id": h["WARC-Record-ID"], "url": h["WARC-Target-URI"], "record_type": kind, "payload_digest": digest,
                            "payload_bytes": len(payload) if kind == "response" else int(h["X-Payload-Length"]),
                            "refers_to": int(h["X-Refers-To-Page-ID"]) if kind == "revisit" else None, "payload": payload,
                        })
                        held += len(payload)
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, fields)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, fields)

    return manifest.repartition(shuffle_partitions(spark), "file").mapInArrow(read, schema)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), base)
    return read_archive(spark, base).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages
), d AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first, 
    list_reduce(list_transform(range(40), lambda i: CAST(instr('0123456789abcdef', hex[i + 1]) - 1 AS VARCHAR)), lambda a, b: a || ',' || b) AS nibbles
  FROM p
), b AS (
  SELECT *, list_transform(string_split(nibbles, ','), lambda x: CAST(x AS BIGINT)) AS n FROM d
)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    (((n[5 * i // 4 + 1] * 256 + coalesce(n[5 * i // 4 + 2], 0) * 16 + coalesce(n[5 * i // 4 + 3], 0)) // (2 ** (7 - (5 * i) % 4))::BIGINT) % 32 + 1)::BIGINT]), lambda a, b: a || b) AS payload_digest,
  CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM b
"""
