"""Datagrams that can be shared: every address rewritten, or the datagram left out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decode as D
from . import templates as T

#: Elements with IPv4 addresses, and with IPv6 ones.
IPV4_ELEMENTS, IPV6_ELEMENTS = {8, 12, 15, 18, 225, 226}, {27, 28, 62, 63, 281, 282}
#: Why datagrams are left out.
REASONS = [None, "not a flow export", "short", "partial record", "unknown template", "options data", "IPv6 element", "odd address length", "malformed set"]


def pseudonym(address: bytes, key: bytes) -> bytes:
    h = 2166136261
    for c in key + address:
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return bytes([10]) + h.to_bytes(4, "big")[1:]


def hashed(h: int, *octets: np.ndarray) -> np.ndarray:
    """FNV-1a of the key's hash and the bytes of addresses, the bits that pseudonyms keep."""
    out = np.full(len(octets[0]), h, np.uint64)
    for o in octets:
        out = (out ^ o.astype(np.uint64)) * np.uint64(16777619) & np.uint64(0xFFFFFFFF)
    return out & np.uint64(0xFFFFFF)


def key_hash(key: bytes) -> int:
    h = 2166136261
    for c in key:
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h


def exporters_of(column: pa.Array, h: int) -> pa.Array:
    """Pseudonyms of addresses as numbers, those of privacy.pseudonym(): beyond 32 bits the first eight hex digits count, and null is hashed as no bytes."""
    x = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    while (wide := x >> np.uint64(32) != 0).any():
        x = np.where(wide, x >> np.uint64(4), x)
    out = hashed(h, *(x >> np.uint64(at) & np.uint64(255) for at in (24, 16, 8, 0))).astype(np.int64)
    if column.null_count:
        out[column.is_null().to_numpy(zero_copy_only=False)] = key_hash(b"") & 0xFFFFFF
    return pa.array(167772160 + out)


def body_places(layout: D.Layout, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, place) of all IPv4 addresses in the bodies lo to hi of data sets, and why each body is unsafe, as a place in REASONS."""
    why, none = np.zeros(len(lo), np.int8), np.zeros(0, np.int64)
    if layout.options:
        return none, none, np.full(len(lo), REASONS.index("options data"), np.int8)
    if not layout.variable and layout.record_len <= 0:
        why[hi > lo] = REASONS.index("partial record")
        return none, none, why
    of, nth, fields = layout.records(data, lo, hi, most=1 << 62)
    stop = lo.copy()
    np.maximum.at(stop, of, fields[-1][0] + fields[-1][1])
    left = stop < hi
    if layout.variable and left.any():  # zeros fill up such a set
        filled = np.concatenate([[0], np.cumsum(data != 0)])
        left &= filled[hi] > filled[stop]
    why[left] = REASONS.index("partial record")
    first, spots = np.zeros(len(of), np.int8), []
    for (ie, _, own), (at, many) in zip(layout.fields, fields):
        if not own and ie in IPV6_ELEMENTS:
            first[first == 0] = REASONS.index("IPv6 element")
        elif not own and ie in IPV4_ELEMENTS:
            first[(first == 0) & (many != 4)] = REASONS.index("odd address length")
            spots.append(at)
    bad = np.flatnonzero(first)
    bad = bad[np.argsort(-nth[bad], kind="stable")]  # of a body's records, the first is told last and stays
    why[of[bad]] = first[bad]
    return np.tile(of, len(spots)), np.concatenate([*spots, none]), why


def clean(batch: pa.RecordBatch, definitions: D.Definitions, h: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(payload, why the datagram is left out as a place in REASONS, addresses rewritten) of a batch."""
    data, offsets = D.bytes_of(batch.column("payload"))
    at, size = offsets[:-1], np.diff(offsets)
    v = np.zeros(len(batch), np.int64)
    v[size >= 4] = D.uint(data, at[size >= 4], 2)
    five, sets = v == 5, np.isin(v, [9, 10])
    why = np.where(five | sets, 0, REASONS.index("not a flow export")).astype(np.int8)
    why[five & ((size - D.HEADER[5]) % D.V5_RECORD != 0)] = REASONS.index("partial record")
    why[five & (size < D.HEADER[5])] = REASONS.index("short")
    row = np.flatnonzero(five & (why == 0))
    of, nth = D.places(row, (size[row] - D.HEADER[5]) // D.V5_RECORD)
    found = [(row[of], at[row][of] + D.HEADER[5] + nth * D.V5_RECORD + k) for k in (0, 4, 8)]

    every = D.sets_in(data, offsets)
    s, told = definitions.of(batch, data, every)
    unsafe = np.where(told < 0, REASONS.index("unknown template"), 0).astype(np.int8)
    for number_ in np.unique(told[told >= 0]).tolist():
        i = np.flatnonzero(told == number_)
        of, spots, unsafe[i] = body_places(definitions.layout(number_), data, s["lo"][i], s["hi"][i])
        found.append((s["row"][i[of]], spots))
    bad = np.flatnonzero(unsafe)
    bad = bad[np.argsort(-s["nth"][bad], kind="stable")]
    why[s["row"][bad]] = unsafe[bad]
    whole = np.flatnonzero(sets & (why == 0) & (size >= np.where(v == 9, D.HEADER[9], D.HEADER[10])))
    reached, end = at + np.where(v == 9, D.HEADER[9], D.HEADER[10]), offsets[1:].copy()
    np.maximum.at(reached, every["row"], every["hi"])
    ten = whole[v[whole] == 10]
    said = D.uint(data, at[ten] + 2, 2)
    short = (said >= D.HEADER[10]) & (said < size[ten])
    end[ten[short]] = at[ten[short]] + said[short]
    why[whole[reached[whole] + 4 <= end[whole]]] = REASONS.index("malformed set")

    keep = why == 0
    rows, spots = (np.concatenate(x) for x in zip(*found))
    rows, spots = rows[keep[rows]], spots[keep[rows]]
    out, new = data.copy(), hashed(h, *(data[spots + k] for k in range(4)))
    out[spots] = 10
    for k in (1, 2, 3):
        out[spots + k] = (new >> np.uint64(24 - 8 * k) & np.uint64(255)).astype(np.uint8)
    ends = np.concatenate([[0], np.cumsum(np.where(keep, size, 0))]).astype(np.int32)
    buffers = [pa.py_buffer(np.packbits(keep, bitorder="little")), pa.py_buffer(ends), pa.py_buffer(out if keep.all() else out[np.repeat(keep, size)])]
    return pa.Array.from_buffers(pa.binary(), len(batch), buffers), why, np.bincount(rows, minlength=len(batch))


def sanitize_datagrams(datagrams: DataFrame, key: bytes, few: int = D.FEW_CHANGES) -> DataFrame:
    """The datagrams with `reason`, null where the payload is rewritten, else why it is left out (payload null).

    Templates count from when they arrive, as in decoding. Filter on `reason IS NULL` for the ones to share. Batches are rewritten
    whole. Templates that a datagram doesn't bring along are sent to the tasks; with more than `few` changes of them, they are joined to
    the datagrams that need them.
    """
    changes, chain = D.changes_of(datagrams, few=few)
    columns, h, shared, given = datagrams.columns, key_hash(key), D.shared_changes(datagrams.sparkSession, changes), datagrams
    joined = chain is not None
    if joined:
        found = T.in_force(D.open_sets(datagrams), chain).groupBy("datagram_id").agg(F.collect_list(F.struct("set_ordinal", "definition")).alias("told"))
        given = datagrams.join(found, "datagram_id", "left").select(*columns, "told")

    def run(batches):
        definitions = Joined() if joined else D.Definitions(*shared.value)
        for batch in D.pieces_of(batches):
            payload, why, count = clean(batch, definitions, h)
            new = {"payload": payload, "exporter_ip": exporters_of(batch.column("exporter_ip"), h)}
            reason = pa.array(np.array(REASONS, object)[why], pa.string())
            yield pa.RecordBatch.from_arrays([*(new[c] if c in new else batch.column(c) for c in columns), reason, pa.array(count, pa.int32())], [*columns, "reason", "rewritten"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in datagrams.schema)
    return given.mapInArrow(run, f"{schema}, reason string, rewritten int")


class Joined(D.Definitions):
    """Definitions of data sets that stand beside their datagrams, in the column `told`."""

    def before(self, batch: pa.RecordBatch, s: dict[str, np.ndarray]) -> np.ndarray:
        found, told = np.full(len(s["row"]), D.NONE), batch.column("told")
        for i, (row, nth) in enumerate(zip(s["row"].tolist(), s["nth"].tolist())):
            text = next((x["definition"] for x in told[row].as_py() or [] if x["set_ordinal"] == nth), None)
            if text is not None:
                found[i] = self.place(text)
        return found


def sanitize_frames(frames: DataFrame, key: bytes) -> DataFrame:
    """Frames of a capture that can be shared, with `rewritten`: how many addresses were.

    Frames that aren't IPv4 go, and so do UDP frames whose payload isn't a flow export that sanitize_datagrams() can rewrite
    whole. In what stays both addresses of the IPv4 header are pseudonyms and its checksum is made anew; the UDP checksum is 0,
    which stands for none.
    """
    from flowloom.sources import pcap

    layers = pcap.with_layers(frames)
    payloads = sanitize_datagrams(pcap.extract_udp(frames), key).select("datagram_id", F.col("payload").alias("clean"), "reason", F.col("rewritten").alias("inner"))
    joined = layers.withColumn("datagram_id", F.when(F.col("udp").isNotNull(), F.xxhash64("file", "seq"))).join(payloads, "datagram_id", "left")
    kept = joined.filter(F.col("udp").isNull() | F.col("reason").isNull() & F.col("clean").isNotNull()).select(*frames.columns, "l3", "after", "udp", "clean", F.coalesce("inner", F.lit(0)).alias("inner"))
    columns = frames.columns

    def rewrite(data: bytes, l3: int, after: int, udp: int | None, clean: bytes | None) -> bytes:
        out = bytearray(data)
        if udp is not None:
            out[udp + 8 : udp + 8 + len(clean)] = clean
            out[udp + 6 : udp + 8] = b"\0\0"
        for at in (l3 + 12, l3 + 16):
            out[at : at + 4] = pseudonym(bytes(out[at : at + 4]), key)
        out[l3 + 10 : l3 + 12] = checksum(bytes(out[l3:after])).to_bytes(2, "big")
        return bytes(out)

    def run(batches):
        for batch in batches:
            done = [rewrite(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("data", "l3", "after", "udp", "clean")))]
            counts = [2 + n for n in batch.column("inner").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array(done, pa.binary()) if c == "data" else batch.column(c) for c in columns), pa.array(counts, pa.int32())], [*columns, "rewritten"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema)
    return kept.mapInArrow(run, f"{schema}, rewritten int")


def checksum(header: bytes) -> int:
    """The checksum of an IPv4 header, whose own field counts as 0."""
    words = [int.from_bytes(header[i : i + 2], "big") for i in range(0, len(header) - 1, 2) if i != 10]
    total = sum(words)
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def statistics(sanitized: DataFrame) -> DataFrame:
    """(reason, datagrams, rewritten): kept ones under a null reason."""
    return sanitized.groupBy("reason").agg(F.count("*").alias("datagrams"), F.sum("rewritten").alias("rewritten"))
