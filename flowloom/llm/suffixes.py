"""Suffix-array deduplication of byte strings that repeat across documents.

A byte is removed if a string of `length` bytes over it also starts in a
document with a smaller id. Sorting all suffixes would move every byte of the
corpus many times, so the difference-cover idea is carried out on a locally
consistent sample (a string synchronising set, the generalisation of a
difference cover): of every `length` bytes at least one position is sampled,
and equal strings are sampled at equal places.

1. Sampled triples. A sampled position stands for (left context, core, right
   context); the core is the `core` bytes from it on, and all three together span
   every string of `length` bytes that the position is the sample of. Triples are
   sorted by core, then by context, across the cluster, and named by rank.
2. A name that several documents have decides all strings around it at once:
   they are removed from every document but the first. A core that one document
   has alone decides that nothing there repeats.
3. Recursion ends here, since a triple spans more than the compared depth.
4. Remaining suffixes: where one core stands in several contexts, the suffixes
   around the first document of each name are sorted by their first `length` bytes
   and merged with each other, and adjacent prefixes are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Rolling, mix, pack, pack_sorted, ragged, released, runs, shuffle_partitions, texts, unpack, unpack_sorted, written

#: Bytes of the core; every 2 in (length - core + 2) positions are sampled.
CORE = 20
MARKED, OPEN = 0, 1
#: Bytes of text whose triples make a range, about.
RANGE_BYTES = 32 << 20


def slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """least over x[i : i + width] for every i with so many from it on."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = least(out[: len(out) - step], out[step:])
        done += step
    return out


def sample(data: np.ndarray, offsets: np.ndarray, roll: Rolling, length: int, core: int) -> dict[str, np.ndarray] | None:
    """Sampled positions of some rows: core and context hashes, row, and the first and last start of the strings
    that each is the sample of, relative to its row."""
    n, w = len(data), length - core + 1
    if n < length:
        return None
    sums = roll.sums(data)
    h = roll.hashes(sums, np.arange(n - core + 1), np.arange(core, n + 1)) | U64(1)
    low = slide(h, w, np.minimum)  # by start of the string
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    end = offsets[1:][row]
    starts = np.arange(n - length + 1)
    low[starts + length > end[: len(starts)]] = 0
    # Position q is the sample of the strings from p on, p in (q - w, q], whose least hash is its own.
    padded = np.concatenate([np.zeros(w - 1, U64), low, np.zeros(w - 1, U64)])
    q = np.flatnonzero(slide(padded, w, np.maximum)[: len(h)] == h)
    if not len(q):
        return None
    near = padded[q[:, None] + np.arange(w)] == h[q][:, None]  # column c: the string that starts at q - (w - 1) + c
    first = q - (w - 1) + near.argmax(1)
    last = q - near[:, ::-1].argmax(1)
    begin = offsets[:-1][row[q]]
    left, right = np.maximum(first, begin), last + length
    # The context holds exactly the bytes of the strings that the position decides, and where they start.
    context = roll.hashes(sums, left, right) ^ mix(((q - left).astype(U64) << U64(32)) + (right - q).astype(U64))
    # The sample takes least hashes, which crowd near zero; mixed again they fill their range evenly.
    return {"core": mix(h[q]), "context": context, "row": row[q], "first": first - begin, "last": last - begin, "at": q - begin}


def intervals(first: np.ndarray, last: np.ndarray) -> bytes:
    """Ranges of string starts, merged, as (start, length) pairs."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > last[:-1] + 1
    at = np.flatnonzero(new)
    lo, hi = first[at], last[np.append(at[1:], len(first)) - 1]
    return np.stack([lo, hi - lo + 1], 1).astype("<u4").tobytes()


def by_document(ids: np.ndarray, first: np.ndarray, last: np.ndarray, kind: int, buckets: int):
    """Rows (bucket, kind, doc_id, data) with the ranges of each document."""
    order = np.argsort(ids, kind="stable")
    ids, first, last = ids[order], first[order], last[order]
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, int)
    ends = np.append(at[1:], len(ids))
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array((mix(ids[at].astype(U64)) % U64(buckets)).astype(np.int32)), "kind": pa.array(np.full(len(at), kind, np.int8)), "doc_id": pa.array(ids[at].astype(np.int64)),
        "data": pa.array([intervals(first[a:b], last[a:b]) for a, b in zip(at, ends)], pa.binary()),
    })


TRIPLES = 2
ROWS = "bucket int, kind byte, doc_id long, data binary"


def triples(batches, roll: Rolling, length: int, core: int, buckets: int):
    """Sampled triples by range of the core; what repeats within one batch is decided at once."""
    shift = U64(64 - buckets.bit_length() + 1)
    for batch in batches:
        ids, parts = batch.column("doc_id").to_numpy(), []
        for lo, _, data, offsets in texts(batch.column("text"), 1 << 20):
            if (got := sample(data, offsets, roll, length, core)) is not None:
                parts.append({**got, "doc": ids[got["row"] + lo]})
        if not parts:
            continue
        core_, context, doc, first, last, at = (np.concatenate([p[k] for p in parts]) for k in ("core", "context", "doc", "first", "last", "at"))
        parts = None
        order = np.lexsort((first, doc, context, core_))
        core_, context, doc, first, last, at = (x[order] for x in (core_, context, doc, first, last, at))
        order = None
        new = np.ones(len(core_), bool)
        new[1:] = (core_[1:] != core_[:-1]) | (context[1:] != context[:-1])
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        late = doc > least
        if late.any():  # an earlier document of this batch has the same triple
            yield by_document(doc[late], first[late], last[late], MARKED, buckets)
        core_, context, doc, first, last, at = (x[~late] for x in (core_, context, doc, first, last, at))
        cuts = np.searchsorted(core_, np.arange(1, buckets, dtype=U64) << shift) if buckets > 1 else np.zeros(0, int)
        rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(core_)])) if hi > lo]
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array([b for b, _, _ in rows], pa.int32()), "kind": pa.array(np.full(len(rows), TRIPLES, np.int8)), "doc_id": pa.array([None] * len(rows), pa.int64()),
            "data": pa.array([encoded(core_[lo:hi] - (U64(b) << shift if buckets > 1 else U64(0)), context[lo:hi], doc[lo:hi], at[lo:hi], at[lo:hi] - first[lo:hi], at[lo:hi] - last[lo:hi]) for b, lo, hi in rows], pa.binary()),
        })


def encoded(core_: np.ndarray, context: np.ndarray, doc: np.ndarray, at: np.ndarray, back: np.ndarray, short: np.ndarray) -> bytes:
    """Columns of triples in the order of their cores, without the bytes that all values of one lack."""
    names, which = np.unique(doc, return_inverse=True)
    low = np.min(names) if len(names) else 0
    columns = [pack_sorted(core_), pack(context), pack((names - low).astype(U64)), pack(which), pack(at), pack(back), pack(short)]
    head = np.array([len(c) for c in columns] + [0], "<i8")
    head[-1] = low
    return head.tobytes() + b"".join(columns)


def decoded(blob: bytes) -> list[np.ndarray]:
    head = np.frombuffer(blob, "<i8", 8)
    ends = 64 + np.cumsum(np.concatenate([[0], head[:7]]))
    core_, context, names, which, at, back, short = (f(blob[a:b]) for f, a, b in zip((unpack_sorted, *(unpack,) * 6), ends, ends[1:]))
    at = at.astype(np.int64)
    return [core_, context, (names.astype(np.int64) + head[7])[which.astype(np.int64)], at - back.astype(np.int64), at - short.astype(np.int64)]


def named(batches, buckets: int):
    """Sorts the triples of a range, names them, and says of each document which strings are decided and which stay open."""
    for part in runs(batches, "bucket"):
        kinds = part["kind"].to_numpy()
        marked = part.filter(pa.array(kinds == MARKED))
        yield from marked.combine_chunks().to_batches()
        blobs = [decoded(x.as_py()) for x in part.filter(pa.array(kinds == TRIPLES))["data"]]
        if not blobs:
            continue
        core_, context, doc, first, last = (np.concatenate(x) for x in zip(*blobs))
        blobs = None
        # Most cores stand alone: only those that occur twice are sorted in full.
        ordered = np.sort(core_)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(twice):
            continue
        keep = twice[np.minimum(np.searchsorted(twice, core_), len(twice) - 1)] == core_
        core_, context, doc, first, last = (x[keep] for x in (core_, context, doc, first, last))
        order = np.lexsort((doc, context, core_))
        core_, context, doc, first, last = (x[order] for x in (core_, context, doc, first, last))
        new_core = np.ones(len(core_), bool)
        new_core[1:] = core_[1:] != core_[:-1]
        new_name = new_core.copy()
        new_name[1:] |= context[1:] != context[:-1]
        name_least = doc[np.flatnonzero(new_name)][np.cumsum(new_name) - 1]
        of_core = np.cumsum(new_core) - 1
        names = np.bincount(of_core, weights=new_name)[of_core]
        heads = np.flatnonzero(new_core)
        several = np.minimum.reduceat(doc, heads)[of_core] < np.maximum.reduceat(doc, heads)[of_core]
        done = doc > name_least
        if done.any():
            yield by_document(doc[done], first[done], last[done], MARKED, buckets)
        left = ~done & (names > 1) & several
        if left.any():
            yield by_document(doc[left], first[left], last[left], OPEN, buckets)


def open_suffixes(batches, roll: Rolling, length: int, buckets: int):
    """(range, data) of the suffixes that stay open, as hashes of their first `length` bytes with document and start."""
    shift = U64(64 - buckets.bit_length() + 1)
    for batch in batches:
        ids, ranges, parts = batch.column("doc_id").to_numpy(), batch.column("data"), []
        for lo, hi, data, offsets in texts(batch.column("text"), 1 << 20):
            sums = roll.sums(data)
            for i in range(lo, hi):
                at = np.frombuffer(b"".join(ranges[i].as_py()), "<u4").reshape(-1, 2).astype(np.int64)
                p = np.unique(ragged(at[:, 0], at[:, 1]))
                p = p[p <= offsets[i - lo + 1] - offsets[i - lo] - length]
                parts.append((roll.hashes(sums, offsets[i - lo] + p, offsets[i - lo] + p + length), np.full(len(p), ids[i]), p))
        if not parts:
            continue
        h, doc, p = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((p, doc, h))
        h, doc, p = h[order], doc[order], p[order]
        cuts = np.searchsorted(h, np.arange(1, buckets, dtype=U64) << shift) if buckets > 1 else np.zeros(0, int)
        rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)])) if hi > lo]
        zero = np.zeros(1, U64)
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
            "data": pa.array([encoded(h[lo:hi] - (U64(b) << shift if buckets > 1 else U64(0)), zero, doc[lo:hi], p[lo:hi], zero, zero) for b, lo, hi in rows], pa.binary()),
        })


def merged(batches, buckets: int):
    """Sorts the open suffixes of a range, compares neighbours, and marks those that an earlier document has too."""
    for part in runs(batches, "bucket"):
        h, doc, p = (np.concatenate(x) for x in zip(*((b[0], b[2], b[3]) for b in (decoded(x.as_py()) for x in part["data"]))))
        order = np.lexsort((doc, h))
        h, doc, p = h[order], doc[order], p[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        late = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        if late.any():
            yield by_document(doc[late], p[late], p[late], MARKED, buckets).select(["doc_id", "data"])


def removals(documents: DataFrame, length: int = 50, core: int = CORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ranges): for documents with something to remove the ranges of string starts, as packed pairs."""
    spark = documents.sparkSession
    roll = Rolling(11)
    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # A range is what a task holds at a time: that of RANGE_BYTES of text. Every batch of rows sends a packed row to each
    # range, or one for each triple where that is less.
    width = max(shuffle_partitions(spark), -(-size // RANGE_BYTES))
    buckets = 1 << (2 * width - 1).bit_length()
    sorted_ = source.mapInArrow(lambda batches: triples(batches, roll, length, core, buckets), ROWS).repartition(width, "bucket").sortWithinPartitions("bucket")
    found = written(sorted_.mapInArrow(lambda batches: named(batches, buckets), ROWS), "suffix-names")
    sorted_ = None
    released(spark)
    still = found.filter(F.col("kind") == OPEN).groupBy("doc_id").agg(F.collect_list("data").alias("data"))
    rest = still.join(source, "doc_id").select("doc_id", "text", "data").mapInArrow(lambda batches: open_suffixes(batches, roll, length, buckets), "bucket int, data binary")
    late = written(rest.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: merged(batches, buckets), "doc_id long, data binary"), "suffix-merged")
    rest = None
    released(spark)
    return found.filter(F.col("kind") == MARKED).select("doc_id", "data").unionByName(late).groupBy("doc_id").agg(F.collect_list("data").alias("ranges"))


def deduplicated(documents: DataFrame, length: int = 50, core: int = CORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document row.

    `kept` is the remaining bytes. Null and empty texts have none. Only documents with a smaller id count,
    so rows that repeat an id are never judged against each other; each stays a row, and places found in
    any of them hold for all of them, as far as their texts reach. Rows with a null id keep everything. An
    empty table gives no rows.
    """
    gone = removals(documents, length, core, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("_id"), text.alias("text")).join(gone, F.col("_id").cast("long") == F.col("doc_id"), "left").select("_id", "text", "ranges")

    def cut(batches):
        for batch in batches:
            ids, ranges, out = batch.column("_id"), batch.column("ranges"), []
            for lo, hi, data, offsets in texts(batch.column("text"), 1 << 20):
                for i in range(lo, hi):
                    own = data[offsets[i - lo] : offsets[i - lo + 1]]
                    n_removed = n_spans = 0
                    if ranges[i].is_valid:
                        at = np.minimum(np.frombuffer(b"".join(ranges[i].as_py()), "<u4").reshape(-1, 2).astype(np.int64), len(own))
                        edge = np.zeros(len(own) + 1, np.int64)
                        np.add.at(edge, at[:, 0], 1)
                        np.add.at(edge, np.minimum(at[:, 0] + at[:, 1] + length - 1, len(own)), -1)
                        removed = np.cumsum(edge[:-1]) > 0
                        n_removed = int(removed.sum())
                        n_spans = int((removed & ~np.concatenate([[False], removed[:-1]])).sum())
                        own = own[~removed]
                    kept = own.tobytes()
                    out.append((int(offsets[i - lo + 1] - offsets[i - lo]), n_removed, n_spans, hashlib.sha256(kept).hexdigest(), kept))
            if out:
                n_bytes, n_removed, n_spans, sha, kept = zip(*out)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    id_type = documents.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("doc_id", id_col)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS p FROM d),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS byte, CASE WHEN 2 * p + 100 <= len(h) THEN substr(h, 2 * p + 1, 100) END AS w FROM b),
m AS (SELECT doc_id, p, byte, w IS NOT NULL AND min(doc_id) OVER (PARTITION BY w) < doc_id AS late FROM s),
r AS (SELECT doc_id, p, byte, bool_or(late) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM r),
t AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept
  FROM e GROUP BY doc_id
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


def by_brute_force(documents: list[tuple[int, str | None]], length: int = 50) -> list[tuple]:
    """The same rows in plain Python, for tests."""
    least: dict[bytes, int] = {}
    raw = [(d, (t or "").encode()) for d, t in documents]
    for d, b in sorted(raw):
        for i in range(len(b) - length + 1):
            least.setdefault(b[i : i + length], d)
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < d:
                gone[i : i + length] = b"\x01" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out
