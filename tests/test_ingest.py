"""Skip rules, clock guard, admission and tenant scope on the cases that matter."""

import pytest
from pyspark.sql import functions as F

from flowloom.functions import exprs as X
from flowloom.operators import ingest as I
from flowloom.operators import registry as G
from flowloom.operators import search as S


def test_skip_rules(spark):
    """The order of the rules, and the first and last address of each private range with their neighbours outside."""
    far = "198.51.100.7"
    inside = ["10.0.0.0", "10.255.255.255", "172.16.0.0", "172.31.255.255", "192.168.0.0", "192.168.255.255", "100.64.0.0", "100.127.255.255"]
    outside = ["9.255.255.255", "11.0.0.0", "172.15.255.255", "172.32.0.0", "192.167.255.255", "192.169.0.0", "100.63.255.255", "100.128.0.0"]
    rows = [(a, "10.77.3.9", 4000, 8443, 7, "private_to_private") for a in inside] + [(a, "10.77.3.9", 4000, 8443, 7, None) for a in outside] + [("10.77.3.9", a, 4000, 8443, 7, None) for a in outside]
    rows += [
        ("10.77.3.9", far, 4000, 53, 7, "dns"), (far, "10.77.3.9", 53, 4000, 7, "dns"), ("10.77.3.9", "10.77.3.10", 4000, 53, 7, "dns"),
        ("10.77.3.9", far, 4000, 53, 0, "zero_bytes"), ("10.77.3.9", "10.77.3.10", 4000, 8443, 0, "zero_bytes"), ("10.77.3.9", far, 4000, 54, 1, None),
    ]
    df = spark.createDataFrame([(n, X.ip(s), X.ip(d), sp, dp, b, r) for n, (s, d, sp, dp, b, r) in enumerate(rows)], "n int, src_ip long, dst_ip long, src_port int, dst_port int, bytes long, wanted string")
    on = df.withColumns({r: F.lit(True) for r in I.RULES})
    assert I.with_skip_reason(on).filter("NOT skip_reason <=> wanted").count() == 0
    off = df.withColumns({r: F.lit(False) for r in I.RULES})
    assert I.apply_skip_rules(off).count() == len(rows)


def test_clock_guard(spark):
    """At both limits of the start, one second in and one out, and at that of the end."""
    back, ahead = -I.PAST_S, I.AHEAD_S
    cases = [
        (None, 10, 0, 0), (back, 10, back, back + 10), (back - 1, 10, 0, 0), (back + 1, 0, back + 1, back + 1), (ahead, 0, ahead, ahead), (ahead + 1, 0, 0, 0), (ahead - 1, 1, ahead - 1, ahead),
        (ahead - 1, 2, ahead - 1, ahead - 1), (0, -1, 0, 0), (-300, 420, -300, ahead), (-300, 421, -300, -300), (-300, None, -300, -300), (back - 1, -back + 1, 0, 0),
    ]
    df = spark.createDataFrame([(1706600000, *c) for c in cases], "received_s long, start_off_s long, dur_s long, start_ long, end_ long")
    assert I.normalize_times(df).filter("start_s <> received_s + start_ OR end_s <> received_s + end_").count() == 0


@pytest.fixture(scope="module")
def registry(spark):
    rows = [(1, 1, "a", X.ip("203.0.113.1"), 11, True, False, None, None), (2, 2, "b", X.ip("203.0.113.2"), 12, False, None, None, None)]
    return spark.createDataFrame(rows, "id long, isp_id int, name string, exporter_ip long, device_id int, enabled boolean, skip_dns boolean, skip_private boolean, skip_zero boolean")


@pytest.mark.parametrize(("mode", "wanted"), [("allow", {(1, 11), (9, 900)}), ("observe", {(1, 11), (0, 0)}), ("reject", {(1, 11)})])
def test_admission(spark, registry, mode, wanted):
    flows = spark.createDataFrame([(X.ip(f"203.0.113.{i}"),) for i in (1, 2, 3)], "exporter_ip long")
    stamped = I.stamp_identity(flows, registry, mode)
    assert {(r.isp_id, r.device_id) for r in I.admit(stamped).collect()} == wanted
    of_first = stamped.filter("device_id = 11").first()
    assert (of_first.skip_dns, of_first.skip_zero) == (False, True)


def test_tenants(spark):
    df = spark.range(4).select(F.col("id").cast("int").alias("isp_id"))
    assert S.scope_isp(df, "director", None).count() == 4
    assert S.scope_isp(df, "user", 2, 2).count() == 1
    for role, own, asked in (("user", 2, 3), ("user", None, 0), ("user", 0, 0)):
        with pytest.raises(S.TenantError):
            S.scope_isp(df, role, own, asked)


def test_search_needs_a_selector(spark):
    with pytest.raises(ValueError):
        S.search(spark.range(1), S.SearchFilter(public_port=80))
    assert S.page_bounds(0, -1) == (50, 0) and S.page_bounds(200, 3) == (200, 3) and S.page_bounds(201, 0) == (50, 0)


def test_text_functions(spark):
    df = spark.createDataFrame([("=1",), ("+a",), ("-",), ("@x",), ("ok",), ("",)], "s string")
    assert [r[0] for r in df.select(X.formula_safe(F.col("s"))).collect()] == ["'=1", "'+a", "'-", "'@x", "ok", ""]
    assert [r[0] for r in df.select(X.or_dash(F.col("s"))).collect()][-1] == "—"
    t = spark.createDataFrame([("2024-01-02T03:04",), ("2024-01-02 03:04:05",), ("2024-01-02T03:04:05+05:30",), ("",), ("x",)], "s string")
    assert [r[0] for r in t.select(X.parse_time(F.col("s"))).collect()] == [1704144840, 1704144845, 1704144845, None, None]
    n = spark.createDataFrame([(None,), (0,), (86399 - 19800,)], "n long").select(*[f(F.col("n")).alias(f.__name__) for f in (X.ist_date, X.ist_clock, X.ist_text, X.or_any, X.duration)]).collect()
    assert list(n[0]) == [None, None, None, "any", None] and [tuple(map(str, r)) for r in n[1:]] == [
        ("1970-01-01", "05:30:00", "1970-01-01 05:30:00", "1970-01-01 05:30", "00:00:00"), ("1970-01-01", "23:59:59", "1970-01-01 23:59:59", "1970-01-01 23:59", "18:29:59"),
    ]
    ips = spark.createDataFrame([("1.2.3.4",), ("1.2.3",), ("256.1.1.1",), ("::1",)], "s string")
    assert [r[0] for r in ips.select(X.inet_aton(F.col("s"))).collect()] == [0x01020304, None, None, None]
    v6 = spark.createDataFrame([(bytes(15) + b"\x01",), (b"\xfe\x80" + bytes(14),), (b"\xfc" + bytes(15),), (b"\x20\x01" + bytes(14),), (b"\x0a\0\0\1",), (b"\x08\x08\x08\x08",)], "a binary")
    assert [r[0] for r in v6.select(X.is_private_binary(F.col("a"))).collect()] == [True, True, True, False, True, False]


def test_device_numbers_and_version(spark, registry):
    assert {r.isp_id: r.next_id for r in G.next_device_id(registry).collect()} == {1: 12, 2: 13}
    version = G.bundle_version(registry).first()[0]
    assert len(version) == 16
    assert version == G.bundle_version(registry.orderBy(F.desc("id"))).first()[0] != G.bundle_version(registry.filter("id = 1")).first()[0]


def test_private_rule_on_ipv6(spark, registry):
    """Addresses of IPv6 are judged on the wire's bytes, before they turn to 0."""
    import ipaddress

    from flowloom.operators import decode as D

    rows = [("fe80::1", "fc00::1"), ("fe80::1", "2001:db8::1"), ("fd00::5", "fd00::6"), ("10.0.0.1", "192.168.0.1"), ("10.0.0.1", "8.8.8.8")]
    at = "timestamp_seconds(1704150000)"
    wire = spark.createDataFrame([(i, ipaddress.ip_address(a).packed, ipaddress.ip_address(b).packed) for i, (a, b) in enumerate(rows)], "n int, src_addr binary, dst_addr binary")
    decoded = wire.selectExpr(
        f"{X.ip('203.0.113.1')}L AS exporter_ip", "src_addr", "dst_addr", "CAST(NULL AS BINARY) AS nat_addr", "n AS src_port", "443 AS dst_port", "0 AS nat_public_port", "6 AS protocol", "9L AS bytes", "1L AS packets",
        "'ipfix' AS flow_type", f"{at} AS recv_ts", "1704150000000L AS start_ms", "1704150000000L AS end_ms",
    )
    raw = D.to_raw_flows(decoded)
    assert sorted(r.src_port for r in I.ingest(raw, registry, "allow").collect()) == [1, 4]
    counted = {r.reason: r.flows for r in I.accounting(raw, registry).collect()}
    assert counted == {"private_to_private": 3, "kept": 2}
