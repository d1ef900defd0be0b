"""Decoding, templates and sanitizing of datagrams that are built byte by byte."""

import datetime as dt
import random
import struct

import pytest
from pyspark.sql import functions as F

from flowloom.functions import exprs as X
from flowloom.operators import decode as D
from flowloom.operators import privacy as P
from flowloom.operators import sanitize as Z
from flowloom.schemas import DATAGRAMS
from flowloom.sources import pcap

AT = dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc)
T0 = int(AT.timestamp())


def ip4(text):
    return X.ip(text).to_bytes(4, "big")


def v5(*records, count=None):
    return struct.pack(">HHIII", 5, len(records) if count is None else count, 1000, T0, 0) + bytes(8) + b"".join(records)


def v5_record(src="10.0.0.1", dst="8.8.8.8", packets=3, size=1500, first=400, last=900, sp=1234, dp=443, proto=6):
    return ip4(src) + ip4(dst) + bytes(8) + struct.pack(">IIIIHHBBBB", packets, size, first, last, sp, dp, 0, 0x12, proto, 7) + bytes(8)


def v9(*sets, domain=1):
    return struct.pack(">HHIIII", 9, len(sets), 1000, T0, 0, domain) + b"".join(sets)


def ipfix(*sets, domain=1):
    body = b"".join(sets)
    return struct.pack(">HHIII", 10, 16 + len(body), T0, 0, domain) + body


def a_set(set_id, body):
    return struct.pack(">HH", set_id, 4 + len(body)) + body


def template(tid, *fields):
    return struct.pack(">HH", tid, len(fields)) + b"".join(struct.pack(">HH", *f) if len(f) == 2 else struct.pack(">HHI", f[0] | 0x8000, f[1], f[2]) for f in fields)


FIELDS = [(8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (1, 4), (2, 4), (22, 4), (21, 4)]


def record(src="10.0.0.1", dst="8.8.8.8"):
    return ip4(src) + ip4(dst) + struct.pack(">HHBIIII", 1234, 443, 6, 1500, 3, 400, 900)


@pytest.fixture()
def table(spark):
    def make(*payloads):
        rows = [(i, AT + dt.timedelta(seconds=i), X.ip(p[0]) if isinstance(p, tuple) else X.ip("203.0.113.1"), 2055, p[1] if isinstance(p, tuple) else p) for i, p in enumerate(payloads)]
        return spark.createDataFrame(rows, DATAGRAMS)

    return make


def test_v5(table):
    rows = D.decode_v5(table(v5(v5_record(), v5_record(dst="1.1.1.1")), v5(v5_record(), count=9), v5(), b"\x00\x05", b"\x00\x09" + bytes(30))).orderBy("datagram_id", "record_ordinal").collect()
    assert [r.datagram_id for r in rows] == [0, 0, 1]
    r = rows[0]
    assert (bytes(r.src_addr), r.src_port, r.dst_port, r.protocol, r.tos, r.tcp_flags, r.bytes, r.packets) == (ip4("10.0.0.1"), 1234, 443, 6, 7, 0x12, 1500, 3)
    assert (r.start_ms, r.end_ms) == (T0 * 1000 - 600, T0 * 1000 - 100)


def test_v9_template_then_data_and_isolation(table):
    sets = a_set(0, template(256, *FIELDS))
    found = D.decode(table(v9(sets), v9(a_set(256, record() + record("10.0.0.2") + b"\0\0")), ("203.0.113.9", v9(a_set(256, record()))), v9(a_set(256, record()), domain=2)))
    rows = found.orderBy("record_ordinal").collect()
    assert [bytes(r.src_addr) for r in rows] == [ip4("10.0.0.1"), ip4("10.0.0.2")]
    assert (rows[0].bytes, rows[0].packets, rows[0].start_ms, rows[0].end_ms) == (1500, 3, T0 * 1000 - 600, T0 * 1000 - 100)
    sets_ = D.split_sets(table(v9(sets), ("203.0.113.9", v9(a_set(256, record())))))
    assert D.unknown_template_sets(D.resolve_templates(sets_, D.extract_templates(sets_))).first().sets == 1


def test_v9_same_datagram_options_and_bad_length(table):
    options = a_set(1, struct.pack(">HHH", 257, 4, 4) + struct.pack(">HHHH", 1, 4, 2, 4))
    rows = D.decode(table(v9(options, a_set(0, template(256, *FIELDS)), a_set(256, record()), a_set(257, bytes(8))), v9(struct.pack(">HH", 256, 2)), v9(struct.pack(">HH", 256, 900)))).collect()
    assert len(rows) == 1


def test_v9_nat_counters_and_observation_time(table):
    fields = [(8, 4), (225, 4), (227, 2), (23, 4), (1, 4), (323, 8)]
    body = ip4("10.0.0.1") + ip4("203.0.113.7") + struct.pack(">HIIQ", 4242, 77, 0, T0 * 1000 - 5)
    r = D.decode(table(v9(a_set(0, template(300, *fields)), a_set(300, body)))).first()
    assert (bytes(r.nat_addr), r.nat_public_port, r.bytes, r.start_ms, r.end_ms) == (ip4("203.0.113.7"), 4242, 0, T0 * 1000 - 5, T0 * 1000 - 5)
    later = [(8, 4), (1, 4), (23, 4)]
    assert D.decode(table(v9(a_set(0, template(300, *later)), a_set(300, ip4("10.0.0.1") + struct.pack(">II", 0, 77))))).first().bytes == 77


def test_ipfix_enterprise_variable_and_withdrawal(table):
    t = a_set(2, template(256, (8, 4), (1, 4, 12345), (12, 4), (82, 0xFFFF), (1, 4)))
    body = ip4("10.0.0.1") + bytes(4) + ip4("8.8.8.8") + b"\x03abc" + struct.pack(">I", 9)
    long = ip4("10.0.0.2") + bytes(4) + ip4("8.8.8.8") + b"\xff\x01\x00" + bytes(256) + struct.pack(">I", 8)
    rows = D.decode(table(ipfix(t, a_set(256, body + long + b"\x01")))).orderBy("record_ordinal").collect()
    assert [(r.bytes, r.start_ms) for r in rows] == [(9, T0 * 1000), (8, T0 * 1000)]
    gone = a_set(2, struct.pack(">HH", 256, 0))
    assert D.decode(table(ipfix(t), ipfix(gone), ipfix(a_set(256, body)))).count() == 0
    assert D.decode(table(ipfix(a_set(2, struct.pack(">HH", 256, 65535) + bytes(8))))).count() == 0


def test_time_to_live_and_cap(table):
    d = table(v9(a_set(0, template(256, *FIELDS))), v9(a_set(256, record())))
    late = d.withColumn("recv_ts", F.expr("recv_ts + make_interval(0, 0, 0, 0, 0, 31 * datagram_id, 0)"))
    assert D.decode(late).count() == 1 and D.decode(late, ttl_s=1800).count() == 0
    many = table(v9(a_set(0, template(256, (8, 4))), *[a_set(256, bytes(4) * 5000)] * 2))
    assert D.decode(many).count() == D.decode(many, few=0).count() == D.RECORDS_PER_DATAGRAM


def test_classify_and_filter(table):
    d = table(v5(v5_record()), v9(), ipfix(), b"\x00\x07" + bytes(40), b"\x00\x05xx", b"")
    assert [r.verdict for r in D.classify_datagrams(d).orderBy("datagram_id").collect()] == ["ok", "ok", "ok", "unsupported", "short", "short"]
    assert D.filter_protocol(d, "netflow5").count() == 2 and D.filter_protocol(d).count() == 6


def test_sanitize(table):
    key = b"secret"
    good = v9(a_set(0, template(256, *FIELDS)), a_set(256, record("198.51.100.77")))
    v6 = v9(a_set(0, template(258, (27, 16))), a_set(258, bytes(16)))
    payloads = [v5(v5_record("198.51.100.77")), good, v9(a_set(999, bytes(4))), v6, v5(v5_record()) + b"\1", b"GET / HTTP/1.0", v9(a_set(0, template(256, *FIELDS)), a_set(256, record() + b"\1"))]
    rows = Z.sanitize_datagrams(table(*payloads), key).orderBy("datagram_id").collect()
    assert [r.reason for r in rows] == [None, None, "unknown template", "IPv6 element", "partial record", "not a flow export", "partial record"]
    for r in rows[:2]:
        assert ip4("198.51.100.77") not in bytes(r.payload) and Z.pseudonym(ip4("198.51.100.77"), key) in bytes(r.payload)
    assert [r.rewritten for r in rows[:2]] == [3, 2]
    assert Z.sanitize_datagrams(table(*payloads), key).orderBy("datagram_id").first().payload == rows[0].payload


def sanitized(payload, templates, key):
    """(payload, reason, rewritten) of one datagram, field by field; templates: (template id: (fields, options)) from before it, which it changes."""
    number = lambda at, n: int.from_bytes(payload[at : at + n], "big")
    v, out, spots = number(0, 2), bytearray(payload), []
    if len(payload) < 4 or v not in D.HEADER:
        return None, "not a flow export", 0
    if len(payload) < D.HEADER[v]:
        return (None, "short", 0) if v == 5 else (payload, None, 0)
    if v == 5:
        if (len(payload) - 24) % 48:
            return None, "partial record", 0
        spots = [at + k for at in range(24, len(payload), 48) for k in (0, 4, 8)]
    end = number(2, 2) if v == 10 and 16 <= number(2, 2) < len(payload) else len(payload)
    at, reason = D.HEADER[v] if v != 5 else len(payload), None
    while at + 4 <= end:
        kind, size = number(at, 2), number(at + 2, 2)
        if size < 4 or at + size > end:
            reason = reason or "malformed set"
            break
        at, stop = at + 4, at + size
        if kind in (D.TEMPLATE_SET[v], D.OPTIONS_SET[v]):
            options = kind == D.OPTIONS_SET[v]
            templates |= {t[0]: None if t[5] else (t[1], options, t[2]) for t in D.templates_of(v, options, payload[at:stop])}
        elif kind >= 256 and not reason:
            told = templates.get(kind)
            reason = "unknown template" if told is None else "options data" if told[1] else ("partial record" if stop > at else None) if not told[0] else reason
            variable = v == 10 and told is not None and any(f["len"] == 65535 for f in told[0])
            while not reason and at < stop:
                here, record = at, []
                for f in told[0]:
                    n = f["len"]
                    if variable and n == 65535:
                        n, here = (number(here, 1), here + 1) if here < stop else (1 << 20, here)
                        if n == 255:
                            n, here = (number(here, 2), here + 2) if here + 2 <= stop else (1 << 20, here)
                    record.append((f, here, n))
                    here += n
                if here > stop:
                    reason = None if variable and not any(payload[at:stop]) else "partial record"
                    break
                for f, spot, n in record:
                    if not f["enterprise"] and not reason and f["ie"] in Z.IPV6_ELEMENTS:
                        reason = "IPv6 element"
                    if not f["enterprise"] and not reason and f["ie"] in Z.IPV4_ELEMENTS:
                        reason = None if n == 4 else "odd address length"
                        spots.append(spot)
                at = here
        at = stop
    if reason:
        return None, reason, 0
    for spot in spots:
        out[spot : spot + 4] = Z.pseudonym(bytes(out[spot : spot + 4]), key)
    return bytes(out), None, len(spots)


def test_sanitized_by_model(table):
    """Odd datagrams, alone and after templates of others, give what a plain reading of one after the other gives."""
    rng = random.Random(4)
    elements = [(8, 4), (12, 4), (7, 2), (4, 1), (1, 8), (225, 4), (226, 4), (15, 4), (5, 1), (8, 4, 9)]
    odd = [(27, 16), (281, 16), (12, 3), (8, 65535), (82, 65535), (18, 65535), (28, 16, 9)]
    payloads = [b"", b"\0\5", b"\0\5" + bytes(9), b"\0\x0a\0", b"\0\x09" + bytes(9), v5(), v5(v5_record())[:-1], ipfix(a_set(256, b"abcd")), v9(a_set(1, struct.pack(">HHH", 257, 4, 4) + struct.pack(">HHHH", 1, 4, 2, 4)), a_set(257, bytes(8)))]
    for _ in range(260):
        nine, sets = rng.random() < 0.4, []
        for _ in range(rng.randint(1, 3)):
            tid, what = rng.choice([256, 257, 258]), rng.random()
            fields = [f for f in rng.choices(elements + odd * (rng.random() < 0.3), k=rng.randint(1, 5)) if not nine or len(f) == 2 and f[1] != 65535]
            if what < 0.55:
                sets.append(a_set(0 if nine else 2, template(tid, *fields)) if rng.random() < 0.9 else a_set(2, struct.pack(">HH", tid, 0)))
            if what > 0.25:
                record = b"".join(rng.randbytes(f[1]) if f[1] != 65535 else (lambda n: bytes([n]) + rng.randbytes(n) if n < 255 else b"\xff" + struct.pack(">H", n) + rng.randbytes(n))(rng.choice([4, 4, 4, 0, 7, 300])) for f in fields)
                sets.append(a_set(tid, record * rng.randint(0, 3) + bytes(rng.choice([0, 0, 0, 1, 3]))))
        body = (v9 if nine else ipfix)(*sets)
        payloads.append(rng.choice([body] * 8 + [body[:-1], body + b"\0\1\0\2", body + b"ab"]))
    payloads.append(v9(a_set(0, template(256, (4, 1))), a_set(256, bytes(60_000))) + a_set(0, template(257, (8, 4))) + a_set(257, rng.randbytes(40_000)))
    wanted, before = [], {}
    for p in payloads:
        wanted.append(sanitized(p, before.setdefault(p[:2], {}), b"key"))
    assert {w[1] for w in wanted} == set(Z.REASONS)
    for few in (D.FEW_CHANGES, 0):
        rows = Z.sanitize_datagrams(table(*payloads), b"key", few).orderBy("datagram_id").collect()
        found = [(None if r.payload is None else bytes(r.payload), r.reason, r.rewritten) for r in rows]
        assert [i for i, (f, w) in enumerate(zip(found, wanted)) if f != w] == []


def test_sanitize_shuffles_nothing(table):
    """Datagrams that bring their templates along are neither joined nor shuffled, nor are others while templates change little."""
    good = ipfix(a_set(2, template(256, (8, 4))), a_set(256, ip4("198.51.100.77")))
    for payloads in ([good] * 3, [good, ipfix(a_set(256, ip4("198.51.100.77")))]):
        shared = Z.sanitize_datagrams(table(*payloads), b"key")
        plan = shared._jdf.queryExecution().toString()
        assert "Exchange" not in plan and "Join" not in plan and shared.filter("rewritten = 1").count() == len(payloads)


def test_sanitized_exporters(spark):
    of = [X.ip("203.0.113.1"), 0, 255, 2**32 - 1, 2**32, 2**40 + 12345, 2**62 + 99, -1, -(2**63), None]
    df = spark.createDataFrame([(i, AT, a, 2055, v5()) for i, a in enumerate(of)], DATAGRAMS)
    found = Z.sanitize_datagrams(df, b"key").select("exporter_ip", "datagram_id").orderBy("datagram_id").collect()
    assert [r[0] for r in found] == [r[0] for r in df.orderBy("datagram_id").select(P.pseudonym(F.col("exporter_ip"), b"key")).collect()]


def frame(payload, vlans=0, cut=None, protocol=17):
    udp = struct.pack(">HHHH", 9999, 2055, 8 + len(payload), 0) + payload
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(udp), 0, 0, 64, protocol, 0) + ip4("203.0.113.1") + ip4("192.0.2.1")
    out = bytes(12) + b"\x81\x00\x00\x05" * vlans + b"\x08\x00" + head + udp
    return out[:cut] if cut else out


@pytest.mark.parametrize(("order", "magic", "unit"), [("<", 0xA1B2C3D4, 1000), (">", 0xA1B2C3D4, 1000), ("<", 0xA1B23C4D, 1), (">", 0xA1B23C4D, 1)])
def test_pcap(spark, tmp_path, order, magic, unit):
    frames = [frame(b"one"), frame(b"two", vlans=2), frame(b"three", cut=44), frame(b"x", protocol=6), bytes(20)]
    data = struct.pack(f"{order}IHHIIII", magic, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack(f"{order}IIII", T0, 5, len(f), len(f)) + f for f in frames)
    (tmp_path / "a.pcap").write_bytes(data)
    rows = pcap.read_pcap(spark, str(tmp_path / "*.pcap"))
    assert rows.count() == 5
    udp = pcap.extract_udp(rows).collect()
    assert sorted(bytes(r.payload) for r in udp) == [b"one", b"th", b"two"]
    assert {r.exporter_ip for r in udp} == {X.ip("203.0.113.1")} and {r.dst_port for r in udp} == {2055}


def test_addresses_are_judged_before_coercion(table):
    t = a_set(2, template(256, (27, 16), (28, 16)))
    r = D.to_raw_flows(D.decode(table(ipfix(t, a_set(256, b"\xfe\x80" + bytes(14) + bytes(15) + b"\x01"))))).first()
    assert (r.src_ip, r.dst_ip, r.both_private) == (0, 0, True)


# Template lives


def flows_of(df):
    return sorted((r.datagram_id, r.set_ordinal, r.record_ordinal, bytes(r.src_addr)) for r in df.collect())


def at_minutes(table, *sent):
    """Datagrams by (minute, payload) or (minute, exporter, payload), in that order."""
    rows = table(*[(s[1], s[2]) if len(s) == 3 else s[1] for s in sent])
    minute = F.element_at(F.array(*[F.lit(float(s[0])) for s in sent]), (F.col("datagram_id") + 1).cast("int"))
    return rows.withColumn("recv_ts", F.timestamp_seconds(F.lit(T0) + (minute * 60).cast("long")))


def test_use_keeps_a_template_alive_within_a_batch(table):
    t, data = v9(a_set(0, template(256, *FIELDS))), v9(a_set(256, record()))
    for few in (D.FEW_CHANGES, 0):
        live = lambda *sent: [r[0] for r in flows_of(D.decode(at_minutes(table, *sent), ttl_s=1800, few=few))]  # noqa: E731, B023
        assert live((0, t), (20, data), (40, data), (60, data)) == [1, 2, 3]
        assert live((0, t), (20, data), (51, data), (60, data)) == [1]
        assert live((0, t), (31, data), (32, t), (40, data)) == [3]
        assert live((0, data), (0, t), (0.5, data), (0.5, data)) == [1 + 1, 3]
        assert live((0, t), (29, t), (58, data), (87, t), (116, data)) == [2, 4]


def test_templates_that_change_within_a_minute(table):
    wide, narrow = a_set(2, template(300, (8, 4), (12, 4))), a_set(2, template(300, (8, 4)))
    body, gone = ip4("10.0.0.1") + ip4("10.0.0.2"), a_set(2, struct.pack(">HH", 300, 0))
    sent = [(0, ipfix(wide)), (0.1, ipfix(a_set(300, body))), (0.2, ipfix(narrow, a_set(300, body))), (0.3, ipfix(gone)), (0.4, ipfix(a_set(300, body))), (0.5, ipfix(wide, a_set(300, body), narrow, a_set(300, body)))]
    for few in (D.FEW_CHANGES, 0):
        found = flows_of(D.decode(at_minutes(table, *sent), ttl_s=1800, few=few))
        assert [r[:3] for r in found] == [(1, 0, 0), (2, 1, 0), (2, 1, 1), (5, 1, 0), (5, 3, 0), (5, 3, 1)]


def test_lives_by_brute_force(spark, table):
    """Random templates, withdrawals and data of two exporters, against a dictionary that is walked in order."""
    import random

    rng = random.Random(4)
    layouts = [[(8, 4)], [(8, 4), (12, 4)], [(8, 4), (7, 2), (11, 2)]]
    sent, state, wanted, minute = [], {}, [], 0.0
    for i in range(400):
        minute += rng.choice([0, 0, 0.01, 0.3, 2, 5, 11])
        exporter, tid, kind = rng.choice(["203.0.113.1", "203.0.113.2"]), rng.choice([256, 257]), rng.random()
        key, now = (exporter, tid), int(minute * 60)
        if key in state and now - state[key][1] > 600:
            del state[key]
        if kind < 0.15:
            fields = rng.choice(layouts)
            sent.append((minute, exporter, ipfix(a_set(2, template(tid, *fields)))))
            state[key] = (sum(n for _, n in fields), now)
        elif kind < 0.2:
            sent.append((minute, exporter, ipfix(a_set(2, struct.pack(">HH", tid, 0)))))
            state.pop(key, None)
        else:
            sent.append((minute, exporter, ipfix(a_set(tid, bytes([10, 0, 0, i % 250]) * 6))))
            if key in state:
                wanted += [(i, 0, k) for k in range(24 // state[key][0])]
                state[key] = (state[key][0], now)
    df = at_minutes(table, *sent)
    assert 100 < len(wanted)
    for few in (D.FEW_CHANGES, 0):
        assert [r[:3] for r in flows_of(D.decode(df, ttl_s=600, few=few))] == wanted
    # The same in batches, what is known carried over.
    from flowloom.operators import templates as L

    known, found = None, []
    for lo in range(0, 400, 57):
        part = df.filter(F.col("datagram_id").between(lo, lo + 56))
        events = D.events_of(part)
        chain = L.chained(events if known is None else known.unionByName(events), 600)
        found += [r[:3] for r in flows_of(D.decode(part, ttl_s=600, chain=chain))]
        known = spark.createDataFrame(L.carried(chain, 600, chain.agg(F.max("latest")).first()[0]).collect(), L.EVENTS)
    assert found == wanted


def test_templates_beyond_the_cap_go_oldest_first(table):
    from flowloom.operators import templates as L

    sent = [(i, v9(a_set(0, template(256 + i, *FIELDS)))) for i in range(5)] + [(9, v9(a_set(257, record())))]
    chain = L.chained(D.events_of(at_minutes(table, *sent)), 3600)
    assert [sorted(r.template_id for r in L.carried(chain, 3600, (T0 + 600) * 10**6, most=n).collect()) for n in (3, 9)] == [[257, 259, 260], [256, 257, 258, 259, 260]]


def test_hot_exporter_is_spread_by_minute(spark):
    """However many sets an exporter sends, a key's chain has a few rows a minute."""
    from flowloom.operators import templates as L

    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("exporter_ip"), F.lit(9).alias("version"), F.lit(1).cast("long").alias("domain"), F.lit(256).alias("template_id"), F.timestamp_seconds(F.lit(T0) + F.col("id") % 600).alias("recv_ts"), F.col("id").alias("datagram_id"), F.lit(0).alias("set_ordinal"), F.lit(0).alias("template_ordinal"), F.when(F.col("id") % 3 == 0, "d").alias("definition"), F.lit(None).cast("timestamp").alias("used"))
    chain = L.chained(rows, 1800)
    assert chain.count() <= 3 * 11 and L.changes(chain).count() == 1


# Captures


def capture(frames, order="<"):
    return struct.pack(f"{order}IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack(f"{order}IIII", T0 + i, i, len(f), len(f)) + f for i, f in enumerate(frames))


@pytest.mark.parametrize("piece", [900, 5000])
def test_pcap_in_pieces(spark, tmp_path, piece):
    """Payloads that look like records themselves, frames longer than pieces, and a cut-off end."""
    import random

    rng = random.Random(piece)
    fake = b"".join(struct.pack("<IIII", T0, 1, 0, 0) for _ in range(40))
    frames = [frame(rng.choice([b"", fake, bytes(rng.randrange(300)), rng.randbytes(rng.randrange(900)), capture([frame(b"x" * k) for k in range(9)])[24:]])) for _ in range(40)]
    (tmp_path / "a.pcap").write_bytes(capture(frames) + struct.pack("<IIII", T0, 0, 50, 50) + b"cut")
    (tmp_path / "b.pcap").write_bytes(capture(frames[:1]))
    (tmp_path / "c.pcap").write_bytes(capture([]))
    found = sorted((r.file[-6:], r.seq, bytes(r.data)) for r in pcap.read_pcap(spark, f"{tmp_path}/*.pcap", piece).collect())
    assert found == [("a.pcap", i, f) for i, f in enumerate(frames)] + [("b.pcap", 0, frames[0])]
    assert pcap.read_pcap(spark, f"{tmp_path}/a.pcap", piece).rdd.getNumPartitions() > 1


def test_sanitized_capture(spark, tmp_path):
    key = b"secret"
    template_frame, data_frame = frame(v9(a_set(0, template(256, *FIELDS)))), frame(v9(a_set(256, record("198.51.100.77"))), vlans=1)
    arp, tcp, odd, unknown = bytes(12) + b"\x08\x06" + bytes(40), frame(b"GET /", protocol=6), frame(b"not a flow export"), frame(v9(a_set(999, bytes(4))))
    frames = [template_frame, data_frame, arp, tcp, odd, unknown, frame(v5(v5_record("198.51.100.77")))]
    (tmp_path / "in.pcap").write_bytes(capture(frames))
    clean = Z.sanitize_frames(pcap.read_pcap(spark, f"{tmp_path}/in.pcap"), key)
    written = pcap.write_pcap(clean.drop("rewritten"), f"{tmp_path}/out").collect()
    assert [r.frames for r in written] == [4]
    rows = pcap.read_pcap(spark, f"{tmp_path}/out/*.pcap").orderBy("seq").collect()

    def plain(data, addresses, payload_at=None):
        out = bytearray(data)
        l3 = 14 + 4 * (data[12:14] == b"\x81\x00")
        for a in addresses:
            for at in range(len(out) - 3):
                if bytes(data[at : at + 4]) == ip4(a):
                    out[at : at + 4] = Z.pseudonym(ip4(a), key)
        out[l3 + 10 : l3 + 12] = b"\0\0"
        total = sum(struct.unpack(">10H", out[l3 : l3 + 20]))
        total = (total & 0xFFFF) + (total >> 16)
        total = (total & 0xFFFF) + (total >> 16)
        out[l3 + 10 : l3 + 12] = struct.pack(">H", ~total & 0xFFFF)
        return bytes(out)

    outer = ["203.0.113.1", "192.0.2.1"]
    v5_clean = bytearray(plain(frames[6], [*outer, "198.51.100.77", "8.8.8.8"]))
    v5_clean[14 + 28 + 24 + 8 : 14 + 28 + 24 + 12] = Z.pseudonym(bytes(4), key)
    assert [bytes(r.data) for r in rows] == [plain(frames[0], outer), plain(frames[1], [*outer, "198.51.100.77", "8.8.8.8"]), plain(frames[3], outer), bytes(v5_clean)]
    assert [r.ts.timestamp() for r in rows] == [T0 + i + i / 1e6 for i in (0, 1, 3, 6)]


def test_full_datagrams_are_worked_on_a_few_at_a_time():
    """A batch of 10,000 datagrams of 8192 records would be 80 million flows at once."""
    import pyarrow as pa

    sizes = [100_000, 0, 5 << 20, 3, 40_000] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([None if not n else bytes([n % 251]) * n for n in sizes], pa.binary())], ["datagram_id", "payload"])
    parts = list(D.pieces_of([batch, batch.slice(7, 0), batch.slice(3, 9)]))
    assert [i for p in parts for i in p.column("datagram_id").to_pylist()] == [*range(len(sizes)), *range(3, 12)]
    for p in parts:
        data, offsets = D.bytes_of(p.column("payload"))
        assert len(p) == 1 or len(data) <= D.PIECE_BYTES
        assert [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])] == [x or b"" for x in p.column("payload").to_pylist()]
