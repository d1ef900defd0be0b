"""Export datagrams to flows, whole Arrow batches at a time.

Where sets and records lie in a batch is worked out for all its datagrams at once, and a field of all records of one
template is one strided read. Templates and data sets are first read without their bodies (`events_of`), from which
templates.py tells what holds when; those changes travel to the tasks while they are few (their number is checked), and
payloads are never shuffled. Beyond that the data sets are joined to them within each key and minute. Where every data set comes
after its template in one datagram, nothing has to be told.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import exprs as X
from flowloom.schemas import TEMPLATE_FIELDS

from . import templates as T

#: Fixed values of the formats: header bytes by version, and the ids of template sets and options template sets.
HEADER = {5: 24, 9: 20, 10: 16}
TEMPLATE_SET, OPTIONS_SET = {9: 0, 10: 2}, {9: 1, 10: 3}
V5_RECORD, V5_MOST, FIRST_DATA_SET, VARIABLE = 48, 30, 256, 0xFFFF
RECORDS_PER_DATAGRAM = 8192
#: Payload that a task works on at a time.
PIECE_BYTES = 1 << 21
SETS = "datagram_id long, recv_ts timestamp, exporter_ip long, version int, domain long, base_ms long, set_ordinal int, set_id int, body binary"
TEMPLATES = f"exporter_ip long, version int, domain long, recv_ts timestamp, datagram_id long, set_ordinal int, template_ordinal int, template_id int, fields {TEMPLATE_FIELDS}, record_len int, has_varlen boolean, is_options boolean, withdrawn boolean"
TEMPLATE = f"struct<fields:{TEMPLATE_FIELDS},record_len:int,has_varlen:boolean,is_options:boolean,withdrawn:boolean>"
#: Addresses as wire bytes, null where there is none, and as numbers, 0 for anything but IPv4; times in ms.
DECODED = (
    "datagram_id long, recv_ts timestamp, exporter_ip long, set_ordinal int, record_ordinal int, flow_type string, src_addr binary, dst_addr binary, nat_addr binary, src_ip long, dst_ip long, nat_public_ip long, "
    "src_port int, dst_port int, nat_public_port int, protocol int, tos int, tcp_flags int, bytes long, packets long, start_ms long, end_ms long"
)
#: What is told of a data set that no template holds for, and of one whose own datagram says nothing of its template.
NONE, OPEN = -1, -2
#: Changes of templates that are sent to every task; with more of them, data sets are joined to them instead.
FEW_CHANGES = 200_000


def version(payload: Column) -> Column:
    return X.field(payload, 0, 2).cast("int")


def filter_protocol(datagrams: DataFrame, proto: str = "any") -> DataFrame:
    """Datagrams of one version (5, 9 or 10 by name), or all."""
    number = {"netflow5": 5, "netflow9": 9, "ipfix": 10}.get(proto)
    return datagrams.filter(F.substring("payload", 1, 2) == F.lit(bytes([0, number]))) if number else datagrams


def classify_datagrams(datagrams: DataFrame) -> DataFrame:
    """Adds `version` and `verdict`: short, unsupported or ok."""
    v, n = version(F.col("payload")), F.length("payload")
    least = F.when(v == 5, HEADER[5]).when(v == 9, HEADER[9]).when(v == 10, HEADER[10])
    verdict = F.when(F.coalesce(n, F.lit(0)) < 2, "short").when(least.isNull(), "unsupported").when(n < least, "short").otherwise("ok")
    return datagrams.withColumns({"version": v, "verdict": verdict})


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a binary column; nulls are empty."""
    column = column.fill_null(b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces_of(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in stretches of datagrams with about `most` bytes of payload: full datagrams decode to many times their size,
    and a batch may hold 10,000 of them."""
    for batch in batches:
        offsets, lo = bytes_of(batch.column("payload"))[1], 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def uint(data: np.ndarray, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Big-endian numbers from at most the last 8 bytes of each stretch; above 2**63 - 1 they wrap."""
    out = np.zeros(len(at), np.int64)
    if isinstance(size, int):
        for i in range(max(0, size - 8), size):
            out = out << 8 | data[at + i]
        return out
    end = at + size
    for i in range(min(8, int(size.max(initial=0))), 0, -1):
        some = size >= i
        out[some] = out[some] << 8 | data[end[some] - i]
    return out


def places(first: np.ndarray, many: np.ndarray, step: int | np.ndarray = 1) -> tuple[np.ndarray, np.ndarray]:
    """(which stretch, number within it from 0) of each of `many` places of every stretch."""
    of = np.repeat(np.arange(len(first)), many)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)


def addresses(data: np.ndarray, at: np.ndarray, size: int | np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(wire bytes, number or 0 where it isn't IPv4) of the stretches."""
    size = np.full(len(at), size) if isinstance(size, int) else size
    of, nth = places(at, size)
    taken = np.ascontiguousarray(data[at[of] + nth])
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    four, number_ = size == 4, np.zeros(len(at), np.int64)
    number_[four] = uint(data, at[four], 4)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(taken)]), number_


def decoded_batch(batch: pa.RecordBatch, row: np.ndarray, columns: dict) -> pa.RecordBatch:
    """The columns of DECODED, the datagram's own by its row in the batch."""
    heads = {c: batch.column(c).take(pa.array(row)) for c in ("datagram_id", "recv_ts", "exporter_ip")}
    kinds = {"set_ordinal": pa.int32(), "record_ordinal": pa.int32(), **dict.fromkeys(("src_port", "dst_port", "nat_public_port", "protocol", "tos", "tcp_flags"), pa.int32())}
    every = heads | {c: v if isinstance(v, pa.Array) else pa.array(v, kinds.get(c)) for c, v in columns.items()}
    names = [c.split(" ")[0] for c in DECODED.split(", ")]
    return pa.RecordBatch.from_arrays([every[c] for c in names], names)


def decode_v5(datagrams: DataFrame) -> DataFrame:
    """Flows of version 5 datagrams; no more records than the payload holds, and 30 at most."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            data, offsets = bytes_of(batch.column("payload"))
            rows = np.flatnonzero(np.diff(offsets) >= HEADER[5])
            at = offsets[rows]
            fits = (offsets[rows + 1] - at - HEADER[5]) // V5_RECORD
            n = np.minimum(np.minimum(uint(data, at + 2, 2), V5_MOST), fits)
            boot = uint(data, at + 8, 4) * 1000 + uint(data, at + 12, 4) // 1_000_000 - uint(data, at + 4, 4)
            of, nth = places(at, n)
            r = at[of] + HEADER[5] + nth * V5_RECORD
            (src, src_ip), (dst, dst_ip) = addresses(data, r, 4), addresses(data, r + 4, 4)
            yield decoded_batch(batch, rows[of], {
                "set_ordinal": np.zeros(len(r), np.int32), "record_ordinal": nth, "flow_type": pa.array(["netflow5"] * len(r)), "src_addr": src, "dst_addr": dst, "nat_addr": pa.nulls(len(r), pa.binary()),
                "src_ip": src_ip, "dst_ip": dst_ip, "nat_public_ip": np.zeros(len(r), np.int64), "src_port": uint(data, r + 32, 2), "dst_port": uint(data, r + 34, 2), "nat_public_port": np.zeros(len(r), np.int64),
                "protocol": uint(data, r + 38, 1), "tos": uint(data, r + 39, 1), "tcp_flags": uint(data, r + 37, 1), "bytes": uint(data, r + 20, 4), "packets": uint(data, r + 16, 4),
                "start_ms": boot[of] + uint(data, r + 24, 4), "end_ms": boot[of] + uint(data, r + 28, 4),
            })

    return filter_protocol(datagrams, "netflow5").select("datagram_id", "recv_ts", "exporter_ip", "payload").mapInArrow(read, DECODED)


def number(data: bytes, at: int, size: int) -> int:
    return int.from_bytes(data[at : at + size], "big")


def sets_in(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """row, nth, set_id, lo, hi (of the body), version, domain and base_ms of all sets of version 9 and 10 datagrams, up to the
    first length in a datagram that is malformed or runs past its end. base_ms is the exporter's boot time for 9, the export time for 10."""
    size = np.diff(offsets)
    v = np.zeros(len(size), np.int64)
    v[size >= 2] = uint(data, offsets[:-1][size >= 2], 2)
    rows = np.flatnonzero((v == 9) & (size >= HEADER[9]) | (v == 10) & (size >= HEADER[10]))
    at, end, v = offsets[rows], offsets[rows + 1].copy(), v[rows]
    nine = v == 9
    said = uint(data, at + 2, 2)
    short = ~nine & (said >= HEADER[10]) & (said < end - at)
    end[short] = at[short] + said[short]
    domain, base = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    domain[nine], domain[~nine] = uint(data, at[nine] + 16, 4), uint(data, at[~nine] + 12, 4)
    base[nine], base[~nine] = uint(data, at[nine] + 8, 4) * 1000 - uint(data, at[nine] + 4, 4), uint(data, at[~nine] + 4, 4) * 1000
    at = at + np.where(nine, HEADER[9], HEADER[10])
    live, nth, found = np.arange(len(rows)), 0, []
    while len(live):  # the nth set of every datagram that has one
        live = live[at[live] + 4 <= end[live]]
        length = uint(data, at[live] + 2, 2)
        good = (length >= 4) & (at[live] + length <= end[live])
        live, length = live[good], length[good]
        found.append((live, np.full(len(live), nth), uint(data, at[live], 2), at[live] + 4, at[live] + length))
        at[live] += length
        nth += 1
    i, nth, set_id, lo, hi = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 5
    return {"row": rows[i], "nth": nth, "set_id": set_id, "lo": lo, "hi": hi, "version": v[i], "domain": domain[i], "base_ms": base[i]}


def of_templates(datagrams: DataFrame) -> DataFrame:
    """Datagrams of versions 9 and 10."""
    return datagrams.filter(F.substring("payload", 1, 2).isin(bytes([0, 9]), bytes([0, 10]))).select("datagram_id", "recv_ts", "exporter_ip", "payload")


def split_sets(datagrams: DataFrame) -> DataFrame:
    """The sets of version 9 and 10 datagrams, each with its body."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            data, offsets = bytes_of(batch.column("payload"))
            s, raw = sets_in(data, offsets), data.tobytes()
            head = batch.select(["datagram_id", "recv_ts", "exporter_ip"]).take(pa.array(s["row"]))
            bodies = pa.array([raw[a:b] for a, b in zip(s["lo"].tolist(), s["hi"].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*head.columns, pa.array(s["version"], pa.int32()), pa.array(s["domain"]), pa.array(s["base_ms"]), pa.array(s["nth"], pa.int32()), pa.array(s["set_id"], pa.int32()), bodies],
                [*head.schema.names, "version", "domain", "base_ms", "set_ordinal", "set_id", "body"])

    return of_templates(datagrams).mapInArrow(walk, SETS)


def templates_of(v: int, options: bool, body: bytes) -> Iterator[tuple]:
    """(template id, fields, record length, has variable lengths, is options, withdrawn) in a template set."""
    if v == 9 and options:
        if len(body) >= 6:
            wanted = number(body, 2, 2) + number(body, 4, 2)
            if 0 < wanted <= len(body) - 6:
                yield number(body, 0, 2), [], sum(number(body, at + 2, 2) for at in range(6, 6 + wanted - 3, 4)), False, True, False
        return
    at, head = 0, 6 if options else 4
    while at + head <= len(body):
        template, count = number(body, at, 2), number(body, at + 2, 2)
        at += head
        if v == 9 and (count == 0 or at + 4 * count > len(body)) or v == 10 and template == 0:
            return
        if count == 0 and not options:
            yield template, [], 0, False, False, True
            continue
        fields = []
        for _ in range(count):
            ie = number(body, at, 2)
            enterprise = v == 10 and ie >= 0x8000
            if at + (8 if enterprise else 4) > len(body):
                return
            fields.append({"ie": ie & 0x7FFF if v == 10 else ie, "len": number(body, at + 2, 2), "enterprise": enterprise})
            at += 8 if enterprise else 4
        fixed = [f["len"] for f in fields if v == 9 or f["len"] != VARIABLE]
        yield template, [] if options else fields, 0 if options else sum(fixed), len(fixed) < len(fields), options, False


def extract_templates(sets: DataFrame) -> DataFrame:
    """A row for each template, options template and withdrawal, in order of arrival."""
    v, s = F.col("version"), F.col("set_id")
    wanted = sets.filter(((v == 9) & s.isin(TEMPLATE_SET[9], OPTIONS_SET[9])) | ((v == 10) & s.isin(TEMPLATE_SET[10], OPTIONS_SET[10])))
    names = [c.split(" ")[0] for c in TEMPLATES.replace(TEMPLATE_FIELDS, "x").split(", ")]
    kinds = pa.schema([("exporter_ip", pa.int64()), ("version", pa.int32()), ("domain", pa.int64()), ("recv_ts", pa.timestamp("us", "UTC")), ("datagram_id", pa.int64()), ("set_ordinal", pa.int32()), ("template_ordinal", pa.int32()), ("template_id", pa.int32()), ("fields", pa.list_(pa.struct([("ie", pa.int32()), ("len", pa.int32()), ("enterprise", pa.bool_())]))), ("record_len", pa.int32()), ("has_varlen", pa.bool_()), ("is_options", pa.bool_()), ("withdrawn", pa.bool_())])

    def read(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                head = [r["exporter_ip"], r["version"], r["domain"], r["recv_ts"], r["datagram_id"], r["set_ordinal"]]
                for nth, found in enumerate(templates_of(r["version"], r["set_id"] == OPTIONS_SET[r["version"]], r["body"])):
                    rows.append(dict(zip(names, [*head, nth, *found])))
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return wanted.mapInArrow(read, TEMPLATES)


def events_of(datagrams: DataFrame) -> DataFrame:
    """T.EVENTS of version 9 and 10 datagrams: every template, options template and withdrawal, and rows without a definition for
    data sets: of those of one template in one second and Arrow batch, the first and the last."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.timestamp("us", "UTC"), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.timestamp("us", "UTC")]
    names = [c.split(" ")[0] for c in T.EVENTS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[tuple[int, str]]] = {}
        for batch in pieces_of(batches):
            data, offsets = bytes_of(batch.column("payload"))
            s, raw = sets_in(data, offsets), data.tobytes()
            v, kind = s["version"], s["set_id"]
            plain, options = kind == np.where(v == 9, TEMPLATE_SET[9], TEMPLATE_SET[10]), kind == np.where(v == 9, OPTIONS_SET[9], OPTIONS_SET[10])
            at, ids, nth, text = [], [], [], []
            for i in np.flatnonzero(plain | options).tolist():
                key = (int(v[i]), bool(options[i]), raw[s["lo"][i] : s["hi"][i]])
                if key not in known:
                    known[key] = [(t[0], definition(*t[1:])) for t in templates_of(*key)]
                for n, (template, told) in enumerate(known[key]):
                    at.append(i), ids.append(template), nth.append(n), text.append(told)
            if len(known) > 10_000:
                known.clear()
            asks = np.flatnonzero(kind >= FIRST_DATA_SET)
            when, ids_ = batch.column("recv_ts").cast(pa.int64()).to_numpy(), batch.column("datagram_id").to_numpy()
            asks = outermost(asks, [s["nth"], ids_[s["row"]], when[s["row"]], when[s["row"]] // 1_000_000, kind, s["domain"], v, batch.column("exporter_ip").to_numpy()[s["row"]]])
            pick = np.concatenate([np.array(at, np.int64), asks])
            head = batch.select(["exporter_ip", "recv_ts", "datagram_id"]).take(pa.array(s["row"][pick]))
            columns = [
                head.column("exporter_ip"), v[pick], s["domain"][pick], np.concatenate([np.array(ids, np.int64), kind[asks]]), head.column("recv_ts"), head.column("datagram_id"), s["nth"][pick],
                np.concatenate([np.array(nth, np.int64), np.zeros(len(asks), np.int64)]), pa.array(text + [None] * len(asks), pa.string()), pa.nulls(len(pick), pa.timestamp("us", "UTC")),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return of_templates(datagrams).mapInArrow(read, T.EVENTS)


def outermost(asks: np.ndarray, by: list[np.ndarray]) -> np.ndarray:
    """Of data sets, the first and the last of each key and second; those between say nothing more about a template's life. by: their
    order and key, the last column first."""
    by = [c[asks] for c in by]
    order = np.lexsort(by)
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = np.any([c[order][1:] != c[order][:-1] for c in by[3:]], axis=0) if len(order) else True
    return asks[order[new[:-1] | new[1:]]]


def definition(fields: list[dict], record_len: int, has_varlen: bool, is_options: bool, withdrawn: bool) -> str:
    if withdrawn:
        return T.WITHDRAWN
    return json.dumps({"fields": fields, "record_len": record_len, "has_varlen": has_varlen, "is_options": is_options, "withdrawn": False}, separators=(",", ":"))


def resolve_templates(sets: DataFrame, templates: DataFrame, ttl_s: int | None = None) -> DataFrame:
    """Data sets with the template that holds for them; null if there is none, or it was withdrawn or neither sent nor used
    for ttl_s seconds. Templates and the heads of data sets alone are ordered, spread by key and minute."""
    told = F.when(F.col("withdrawn"), T.WITHDRAWN).otherwise(F.to_json(F.struct("fields", "record_len", "has_varlen", "is_options", "withdrawn")))
    said = templates.select(*T.KEY, *T.ARRIVAL, told.alias("definition"))
    data = sets.filter(F.col("set_id") >= FIRST_DATA_SET)
    asks = data.select("exporter_ip", "version", "domain", F.col("set_id").alias("template_id"), "recv_ts", "datagram_id", "set_ordinal", F.lit(0).alias("template_ordinal"))
    events = said.unionByName(asks, allowMissingColumns=True).withColumn("used", F.lit(None).cast("timestamp"))
    found = T.in_force(asks, T.chained(events, ttl_s), ttl_s)
    of = found.select("datagram_id", "set_ordinal", F.from_json("definition", TEMPLATE).alias("template"))
    return data.join(of, ["datagram_id", "set_ordinal"], "left")


def unknown_template_sets(resolved: DataFrame) -> DataFrame:
    return resolved.filter("template IS NULL").groupBy("exporter_ip", "version", "domain", "set_id").agg(F.count("*").alias("sets"))


class Layout:
    """Where the fields of a template's records lie: `of` finds an element's last, or first, field."""

    def __init__(self, told: str):
        t = json.loads(told)
        self.fields = [(f["ie"], f["len"], f["enterprise"]) for f in t["fields"]]
        self.options, self.variable, self.record_len = t["is_options"], t["has_varlen"], t["record_len"]

    def of(self, *ids: int, last: bool = True) -> int | None:
        found = [i for i, (ie, _, own) in enumerate(self.fields) if ie in ids and not own]
        return found[-1 if last else 0] if found else None

    def records(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int = RECORDS_PER_DATAGRAM) -> tuple[np.ndarray, np.ndarray, list]:
        """(set, number in it, [(places, lengths) of each field]) of the records in the bodies lo to hi; a cut-off tail is ignored."""
        if self.options or not (self.variable or self.record_len > 0):
            none = np.zeros(0, np.int64)
            return none, none, [(none, size) for _, size, _ in self.fields]
        if not self.variable:
            of, nth = places(lo, np.minimum((hi - lo) // self.record_len, most))
            at, out = lo[of] + nth * self.record_len, []
            for _, size, _ in self.fields:
                out.append((at, size))
                at = at + size
            return of, nth, out
        live, at, nth, found = np.arange(len(lo)), lo.copy(), 0, []
        while len(live) and nth < most:  # the nth record of every set that has one
            here, begun, spots = at[live], at[live], []
            good = here < hi[live]
            for _, size, _ in self.fields:
                many = np.full(len(live), size)
                if size == VARIABLE:
                    good &= here < hi[live]
                    many[good] = data[here[good]]
                    here = here + 1
                    long = good & (many == 255)
                    good &= ~long | (here + 2 <= hi[live])
                    long &= good
                    many[long] = uint(data, here[long], 2)
                    here = here + 2 * long
                many = np.where(good, many, 0)
                good &= here + many <= hi[live]
                spots.append((here, many))
                here = here + many
            good &= here > begun
            at[live[good]] = here[good]
            live = live[good]
            found.append((live, np.full(len(live), nth), [(p[good], m[good]) for p, m in spots]))
            nth += 1
        sets_, numbers, spots = zip(*found) if found else ((), (), ())
        join = lambda parts: np.concatenate(list(parts)) if found else np.zeros(0, np.int64)
        return join(sets_), join(numbers), [(join(s[i][0] for s in spots), join(s[i][1] for s in spots)) for i in range(len(self.fields))]

    def flows(self, data: np.ndarray, fields: list, n: int, v9: bool, base: np.ndarray) -> dict:
        """The columns of DECODED that come from elements.

        The outgoing byte counter counts only where the incoming one is 0. Version 9: switch times count from
        boot, observation times fill what has no time. Version 10: what has no time takes the export time.
        """
        value = lambda i: uint(data, *fields[i])
        count = lambda *ids: np.zeros(n, np.int64) if (i := self.of(*ids)) is None else value(i)

        def total() -> np.ndarray:
            into, out = self.of(1), self.of(23)
            if into is None or out is None or out < into:
                return count(23) if into is None else value(into)
            return np.where(value(into) != 0, value(into), value(out))

        def time(switched: int, seconds: int, ms: int) -> pa.Array:
            i = self.of(switched, ms) if v9 else self.of(seconds, ms)
            if i is None and v9:
                seen = self.of(322, 323, last=False)
                return pa.nulls(n, pa.int64()) if seen is None else pa.array(value(seen) * (1 if self.fields[seen][0] == 323 else 1000))
            if i is None:
                return pa.array(base)
            ie = self.fields[i][0]
            return pa.array(base + value(i) if ie == switched and v9 else value(i) * 1000 if ie == seconds and not v9 else value(i))

        out = {}
        for name, number_, ids in (("src_addr", "src_ip", (8, 27)), ("dst_addr", "dst_ip", (12, 28)), ("nat_addr", "nat_public_ip", (225,))):
            i = self.of(*ids)
            out[name], out[number_] = (pa.nulls(n, pa.binary()), np.zeros(n, np.int64)) if i is None else addresses(data, *fields[i])
        for name, ie, bits in (("src_port", 7, 16), ("dst_port", 11, 16), ("nat_public_port", 227, 16), ("protocol", 4, 8), ("tos", 5, 8), ("tcp_flags", 6, 8)):
            out[name] = count(ie) & ((1 << bits) - 1)
        return out | {"bytes": total(), "packets": count(2), "start_ms": time(22, 150, 152), "end_ms": time(21, 151, 153)}


def within_cap(row: np.ndarray, ordinal: np.ndarray, nth: np.ndarray, most: int = RECORDS_PER_DATAGRAM) -> np.ndarray:
    """Which records are among the first `most` of their datagram, counted across its sets in order."""
    if not len(row) or np.bincount(row).max() <= most:
        return np.ones(len(row), bool)
    order = np.lexsort((nth, ordinal, row))
    sorted_ = row[order]
    keep = np.empty(len(row), bool)
    keep[order] = np.arange(len(row)) - np.searchsorted(sorted_, sorted_) < most
    return keep


def decoded_sets(batch: pa.RecordBatch, data: np.ndarray, s: dict[str, np.ndarray], told: np.ndarray, names: list[str], layouts: dict[str, Layout]) -> Iterator[pa.RecordBatch]:
    """Flows of the data sets `s` of a batch; told: each set's definition as a place in names, below 0 for none."""
    parts = []
    for number_ in np.unique(told[told >= 0]).tolist():
        if names[number_] not in layouts:
            layouts[names[number_]] = Layout(names[number_])
        layout = layouts[names[number_]]
        for v in (9, 10):
            i = np.flatnonzero((told == number_) & (s["version"] == v))
            of, nth, fields = layout.records(data, s["lo"][i], s["hi"][i])
            if len(of):
                parts.append((i[of], nth, layout, fields, v == 9))
    if not parts:
        return
    which, nth = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    keep = within_cap(s["row"][which], s["nth"][which], nth)
    columns = [layout.flows(data, fields, len(i), nine, s["base_ms"][i]) | {"flow_type": pa.array(["netflow9" if nine else "ipfix"] * len(i))} for i, _, layout, fields, nine in parts]
    merged = {c: pa.concat_arrays([x[c] if isinstance(x[c], pa.Array) else pa.array(x[c]) for x in columns]) for c in columns[0]}
    kinds = dict.fromkeys(("src_port", "dst_port", "nat_public_port", "protocol", "tos", "tcp_flags"), pa.int32())
    merged = {c: a.cast(kinds[c]) if c in kinds else a for c, a in merged.items()} | {"set_ordinal": pa.array(s["nth"][which], pa.int32()), "record_ordinal": pa.array(nth, pa.int32())}
    if not keep.all():
        which, merged = which[keep], {c: a.filter(pa.array(keep)) for c, a in merged.items()}
    yield decoded_batch(batch, s["row"][which], merged)


class Definitions:
    """Which definition holds for each data set of a batch: the last before it in its own datagram, else the last before it among
    the given changes. A definition goes by its place in `names`."""

    def __init__(self, columns: list[np.ndarray] | None = None, states: np.ndarray | None = None, names: list[str] | None = None):
        self.columns, self.states, self.given = columns, states, names or []
        self.forget()

    def forget(self) -> None:
        self.names, self.number, self.read = list(self.given), {x: i for i, x in enumerate(self.given)}, {}
        self.layouts: dict[str, Layout] = {}

    def place(self, text: str) -> int:
        if text == T.WITHDRAWN:
            return NONE
        if text not in self.number:
            self.number[text] = len(self.names)
            self.names.append(text)
        return self.number[text]

    def layout(self, number_: int) -> Layout:
        name = self.names[number_]
        if name not in self.layouts:
            self.layouts[name] = Layout(name)
        return self.layouts[name]

    def own(self, data: np.ndarray, s: dict[str, np.ndarray]) -> np.ndarray:
        """What their own datagrams say of the data sets."""
        if max(len(self.read), len(self.names) - len(self.given)) > 10_000:
            self.forget()
        v, kind, raw = s["version"], s["set_id"], data.tobytes()
        options = kind == np.where(v == 9, OPTIONS_SET[9], OPTIONS_SET[10])
        says, asks = np.flatnonzero(options | (kind == np.where(v == 9, TEMPLATE_SET[9], TEMPLATE_SET[10]))), np.flatnonzero(kind >= FIRST_DATA_SET)
        at, ids, told = [], [], []
        for i, *key, lo, hi in zip(says.tolist(), v[says].tolist(), options[says].tolist(), s["lo"][says].tolist(), s["hi"][says].tolist()):
            key = (*key, raw[lo:hi])
            if key not in self.read:
                self.read[key] = [(template, self.place(definition(*told_))) for template, *told_ in templates_of(*key)]
            for template, number_ in self.read[key]:
                at.append(i), ids.append(template), told.append(number_)
        n = len(at)
        pick = np.concatenate([np.array(at, np.int64), asks])
        row, ids, nth = s["row"][pick], np.concatenate([np.array(ids, np.int64), kind[asks]]), s["nth"][pick]
        order = np.lexsort((nth, ids, row))  # of one set's templates with one id, the last stays last
        is_set = order >= n
        last = np.maximum.accumulate(np.where(is_set, -1, np.arange(len(order))))
        change = order[np.maximum(last, 0)]
        good = is_set & (last >= 0) & (row[change] == row[order]) & (ids[change] == ids[order])
        found = np.full(len(order), OPEN)
        found[order[good]] = np.array(told, np.int64)[change[good]]
        return found[n:]

    def before(self, batch: pa.RecordBatch, s: dict[str, np.ndarray]) -> np.ndarray:
        """What the changes say of data sets: changes and sets in order of arrival, key by key; a set takes the last of its key before it."""
        if self.columns is None:
            return np.full(len(s["row"]), OPEN)
        exporters = batch.column("exporter_ip").to_numpy()
        here = np.flatnonzero(np.isin(self.columns[0], exporters))
        *keys, at, datagram, ordinal, nth = (c[here] for c in self.columns)
        told = self.states[here]
        n, row = len(told), s["row"]
        asks = [exporters[row], s["version"], s["domain"], s["set_id"]]
        arrived = [batch.column("recv_ts").cast(pa.int64()).to_numpy()[row], batch.column("datagram_id").to_numpy()[row], s["nth"], np.zeros(len(row), np.int64)]
        both = [np.concatenate(x) for x in zip([*keys, at, datagram, ordinal, nth], [*asks, *arrived])]
        is_set = np.repeat([False, True], [n, len(row)])
        order = np.lexsort((is_set, *both[::-1]))
        last = np.maximum.accumulate(np.where(is_set[order], -1, np.arange(len(order))))
        change = order[np.maximum(last, 0)]
        good = is_set[order] & (last >= 0)
        for k in both[:4]:
            good &= k[change] == k[order]
        found = np.full(n + len(row), NONE, np.int64)
        found[order[good]] = told[change[good]]
        return found[n:]

    def of(self, batch: pa.RecordBatch, data: np.ndarray, s: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(the data sets among the sets of a batch, each one's definition or below 0)."""
        told = self.own(data, s)
        s = {c: x[s["set_id"] >= FIRST_DATA_SET] for c, x in s.items()}
        ask = np.flatnonzero(told == OPEN)
        if len(ask):
            told[ask] = self.before(batch, {c: x[ask] for c, x in s.items()})
        return s, told


def open_sets(datagrams: DataFrame) -> DataFrame:
    """(KEY, ARRIVAL) of the data sets that no template comes before in their own datagram."""
    names = [*T.KEY, *T.ARRIVAL]
    schema = ", ".join(c for c in T.EVENTS.split(", ") if c.split(" ")[0] in names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definitions = Definitions()
        for batch in pieces_of(batches):
            data, offsets = bytes_of(batch.column("payload"))
            s, told = definitions.of(batch, data, sets_in(data, offsets))
            s = {c: x[told == OPEN] for c, x in s.items()}
            heads = {c: batch.column(c).take(pa.array(s["row"])) for c in ("exporter_ip", "recv_ts", "datagram_id")}
            of = {"version": pa.array(s["version"], pa.int32()), "domain": pa.array(s["domain"]), "template_id": pa.array(s["set_id"], pa.int32()), "set_ordinal": pa.array(s["nth"], pa.int32()), "template_ordinal": pa.array(np.zeros(len(s["row"]), np.int32))}
            if len(s["row"]):
                yield pa.RecordBatch.from_arrays([(heads | of)[c] for c in names], names)

    return of_templates(datagrams).mapInArrow(read, schema)


def shared_changes(spark: SparkSession, changes: pa.Table | None) -> Broadcast:
    """The arguments of Definitions for tasks."""
    if changes is None:
        return spark.sparkContext.broadcast(())
    columns = [changes[c].to_numpy(zero_copy_only=False) for c in T.KEY] + [changes["recv_ts"].cast(pa.int64()).to_numpy(), changes["datagram_id"].to_numpy(), changes["set_ordinal"].to_numpy(), changes["template_ordinal"].to_numpy()]
    texts = changes["state"].to_pylist()
    names = sorted(set(texts) - {T.WITHDRAWN})
    number_ = {x: i for i, x in enumerate(names)}
    return spark.sparkContext.broadcast((columns, np.array([number_.get(x, NONE) for x in texts], np.int64), names))


def decode_by(datagrams: DataFrame, changes: pa.Table | None) -> DataFrame:
    """Flows of version 9 and 10 datagrams under the given changes of templates, which go to every task."""
    shared = shared_changes(datagrams.sparkSession, changes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definitions = Definitions(*shared.value)
        for batch in pieces_of(batches):
            data, offsets = bytes_of(batch.column("payload"))
            s, told = definitions.of(batch, data, sets_in(data, offsets))
            yield from decoded_sets(batch, data, s, told, definitions.names, definitions.layouts)

    return of_templates(datagrams).mapInArrow(read, DECODED)


def decode_resolved(resolved: DataFrame) -> DataFrame:
    """Flows of data sets that carry their template. A datagram's sets needn't be in one task, so the cap is taken by a window."""
    rows = resolved.filter("template IS NOT NULL").select("datagram_id", "recv_ts", "exporter_ip", "version", "base_ms", "set_ordinal", F.col("body").alias("payload"), F.to_json("template").alias("told"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts: dict[str, Layout] = {}
        for batch in pieces_of(batches):
            data, offsets = bytes_of(batch.column("payload"))
            names, told = np.unique(batch.column("told").to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
            s = {"row": np.arange(len(batch)), "nth": batch.column("set_ordinal").to_numpy().astype(np.int64), "lo": offsets[:-1], "hi": offsets[1:], "version": batch.column("version").to_numpy(), "base_ms": batch.column("base_ms").to_numpy()}
            yield from decoded_sets(batch, data, s, told, list(names), layouts)

    return cap_records(rows.mapInArrow(read, DECODED))


def cap_records(records: DataFrame, most: int = RECORDS_PER_DATAGRAM) -> DataFrame:
    """At most so many records of each datagram, counted across its sets in order: by sums over sets, of which those before a
    record's own count."""
    sets = records.groupBy("datagram_id", "set_ordinal").agg(F.count("*").alias("n"))
    over = sets.groupBy("datagram_id").agg(F.sum("n").alias("all"), F.collect_list(F.struct("set_ordinal", "n")).alias("sets")).filter(F.col("all") > most).select("datagram_id", "sets")
    before = F.aggregate(F.filter("sets", lambda x: x["set_ordinal"] < F.col("set_ordinal")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return records.join(over, "datagram_id", "left").filter(F.col("sets").isNull() | (before + F.col("record_ordinal") < most)).drop("sets")


def changes_of(datagrams: DataFrame, ttl_s: int | None = None, known: DataFrame | None = None, chain: DataFrame | None = None, few: int = FEW_CHANGES) -> tuple[pa.Table | None, DataFrame | None]:
    """(changes of templates for all tasks, None), or (None, T.chained()) if they are more than `few`. (None, None) where no data set needs them."""
    if chain is None:
        if not open_sets(datagrams).limit(1).count():  # every task stops at its first
            return None, None
        events = events_of(datagrams)
        chain = T.chained(events if known is None else known.unionByName(events), ttl_s)
    changes = T.changes(chain).limit(few + 1).toArrow()  # few rows, or the sign that they aren't
    return (changes, None) if len(changes) <= few else (None, chain)


def decode(datagrams: DataFrame, ttl_s: int | None = None, known: DataFrame | None = None, chain: DataFrame | None = None, few: int = FEW_CHANGES) -> DataFrame:
    """Decoded flows of all three versions, as DECODED.

    A template lives for ttl_s seconds after it was last sent or used (None: for ever). `known` are templates from before
    these datagrams, from T.carried(); `chain` is T.chained() of them and these, if it is there already.
    """
    changes, chain = changes_of(datagrams, ttl_s, known, chain, few)
    if chain is None:
        return decode_v5(datagrams).unionByName(decode_by(datagrams, changes))
    data = split_sets(datagrams).filter(F.col("set_id") >= FIRST_DATA_SET)
    asks = data.select("exporter_ip", "version", "domain", F.col("set_id").alias("template_id"), "recv_ts", "datagram_id", "set_ordinal", F.lit(0).alias("template_ordinal"))
    of = T.in_force(asks, chain, ttl_s).select("datagram_id", "set_ordinal", F.from_json("definition", TEMPLATE).alias("template"))
    return decode_v5(datagrams).unionByName(decode_resolved(data.join(of, ["datagram_id", "set_ordinal"])))


def to_raw_flows(decoded: DataFrame) -> DataFrame:
    """Decoded flows as ingest takes them; whether an end is private is judged before anything but IPv4 turns to 0. Rows that come
    without the addresses' numbers get them from the bytes."""
    for address, number_ in (("src_addr", "src_ip"), ("dst_addr", "dst_ip"), ("nat_addr", "nat_public_ip")):
        if number_ not in decoded.columns:
            decoded = decoded.withColumn(number_, X.coerce_ipv4(F.col(address)))
    cut = lambda c: F.floor(F.col(c) / 1000)
    private = lambda address, number_: F.when(F.length(address) == 4, X.is_private(F.col(number_))).otherwise(F.coalesce(X.is_private_v6(F.col(address)), F.lit(False)))
    return decoded.select(
        "exporter_ip", "src_ip", "src_port", "dst_ip", "dst_port", "nat_public_ip", "nat_public_port",
        "protocol", "bytes", "packets", "flow_type", F.unix_seconds("recv_ts").alias("received_s"), (cut("start_ms") - F.unix_seconds("recv_ts")).alias("start_off_s"), (cut("end_ms") - cut("start_ms")).alias("dur_s"),
        (private("src_addr", "src_ip") & private("dst_addr", "dst_ip")).alias("both_private"),
    )


#: Decoders by name, each from datagrams to decoded flows: the point where others can be added.
DECODERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "netflow5": lambda d: decode_v5(filter_protocol(d, "netflow5")),
    "netflow9": lambda d: decode(filter_protocol(d, "netflow9")),
    "ipfix": lambda d: decode(filter_protocol(d, "ipfix")),
    "any": decode,
}
