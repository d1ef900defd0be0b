"""Flow tables derived from the star schema by integer arithmetic, in text that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import exprs as X
from flowloom.operators import ingest

AS_OF = "2024-01-30"
#: Noon UTC of that day.
AS_OF_S = 1706572800 + 43200

RAW_FLOWS = """
SELECT l_orderkey*8 + l_linenumber AS flow_id,
 CASE WHEN l_suppkey % 20 = 0 THEN 3405803776 + l_suppkey ELSE 3325256704 + l_suppkey END AS exporter_ip,
 CASE WHEN l_linenumber = 7 THEN 134744072 + l_partkey ELSE 1681915904 + l_partkey END AS src_ip,
 CAST(1024 + l_orderkey % 64000 AS INT) AS src_port,
 CASE WHEN l_linenumber = 6 THEN 167772160 + l_suppkey ELSE 134744072 + l_suppkey END AS dst_ip,
 CAST(CASE l_linenumber WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 80 ELSE 8080 END AS INT) AS dst_port,
 CAST(CASE WHEN l_linenumber = 5 THEN 0 ELSE 3405803776 + l_partkey % 64 END AS BIGINT) AS nat_public_ip,
 CAST(CASE WHEN l_linenumber = 5 THEN 0 ELSE 1024 + l_partkey % 60000 END AS INT) AS nat_public_port,
 CAST(CASE WHEN l_returnflag = 'A' THEN 6 WHEN l_returnflag = 'N' THEN 17
           WHEN l_linestatus = 'O' THEN 1 ELSE 47 END AS INT) AS protocol,
 CAST(CASE WHEN l_discount = 0 THEN 0 ELSE floor(l_extendedprice) END AS BIGINT) AS bytes,
 CAST(floor(l_quantity) AS BIGINT) AS packets,
 CASE l_orderkey % 3 WHEN 0 THEN 'netflow5' WHEN 1 THEN 'netflow9' ELSE 'ipfix' END AS flow_type,
 CAST(1704067200 + (l_orderkey % 30)*86400 + (l_orderkey*37 + l_linenumber*4001) % 86400 AS BIGINT) AS received_s,
 CAST(CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN -7201 WHEN 2 THEN 121 WHEN 3 THEN -7200
                         WHEN 4 THEN 120 ELSE -(l_suppkey % 7000) END AS BIGINT) AS start_off_s,
 CAST(floor(l_quantity) AS BIGINT) AS dur_s
FROM lineitem"""

DEVICES = """
SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(1 + s_suppkey % 4 AS INT) AS isp_id, s_name AS name,
 3325256704 + s_suppkey AS exporter_ip, CAST(1 + s_suppkey AS INT) AS device_id,
 CASE s_suppkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'netflow5' WHEN 2 THEN 'netflow9' ELSE 'sflow' END AS protocol,
 CASE WHEN s_suppkey % 7 = 0 THEN 'unknown-box' ELSE 'generic' END AS profile,
 CASE s_suppkey % 3 WHEN 0 THEN 'lean' WHEN 1 THEN 'full' ELSE 'none' END AS capture_policy,
 s_suppkey % 10 <> 9 AS enabled, s_nationkey % 2 = 0 AS skip_dns,
 s_nationkey % 3 = 0 AS skip_private, s_nationkey % 5 <> 0 AS skip_zero
FROM supplier"""

#: Two policies for each region: one that everyone has, and one of a tenant's own.
POLICIES = """
SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(0 AS INT) AS isp_id, CASE WHEN r_regionkey % 2 = 0 THEN 'lean' ELSE 'full' END AS name,
 r_regionkey % 2 = 0 AS skip_dns, true AS skip_private, r_regionkey < 3 AS skip_zero FROM region WHERE r_regionkey < 2
UNION ALL
SELECT CAST(10 + r_regionkey AS BIGINT) AS id, CAST(r_regionkey AS INT) AS isp_id, 'lean' AS name,
 false AS skip_dns, r_regionkey % 2 = 1 AS skip_private, true AS skip_zero FROM region WHERE r_regionkey > 0"""

#: Days that are in the books already: every nation's day in January.
ARCHIVED = """
SELECT CAST('2024-01-01' AS DATE) + CAST(n_nationkey AS INT) AS day, CAST(4 AS INT) AS objects, CAST(100 + n_nationkey AS BIGINT) AS rows,
 CAST(1000 AS BIGINT) AS bytes, CAST(1706572800 + n_nationkey AS BIGINT) AS archived_s FROM nation WHERE n_nationkey % 3 = 0"""

AUDIT = """
SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(1 + o_custkey % 4 AS INT) AS isp_id, CAST(o_custkey AS BIGINT) AS query_ip,
 CAST(o_orderkey % 5000 AS INT) AS result_count FROM orders"""


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "lineitem")
    return spark.sql(RAW_FLOWS)


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "supplier")
    return spark.sql(DEVICES)


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "region")
    return spark.sql(POLICIES)


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "nation")
    return spark.sql(ARCHIVED.replace("CAST('2024-01-01' AS DATE) + CAST(n_nationkey AS INT)", "date_add(CAST('2024-01-01' AS DATE), CAST(n_nationkey AS INT))")).withColumn("archived_at", F.timestamp_seconds("archived_s")).drop("archived_s")


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return spark.sql(AUDIT)


def flow_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest(raw_flows(spark, sf_dir), devices(spark, sf_dir))


def wire(n, size: int):
    """A number as so many big-endian bytes."""
    return F.unhex(F.lpad(F.hex(n.cast("long") if hasattr(n, "cast") else F.lit(n)), 2 * size, "0"))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores: the tables here are single Parquet row groups, which one task reads. Parts are of the advisory size of
    adaptive execution, so large tables make more of them, not larger ones."""
    return df.hint("rebalance")


def datagrams_v5(raw: DataFrame) -> DataFrame:
    """A version 5 datagram for every flow, whose start is 100 s before it was received."""
    raw = spread(raw)
    c, zero = F.col, lambda size: F.lit(bytes(size))
    head = [wire(5, 2), wire(1, 2), wire(200000, 4), wire(c("received_s"), 4), zero(12)]
    body = [
        wire(c("src_ip"), 4), wire(c("dst_ip"), 4), zero(8), wire(c("packets"), 4), wire(c("bytes"), 4), wire(100000, 4), wire(100000 + c("dur_s") * 1000, 4),
        wire(c("src_port"), 2), wire(c("dst_port"), 2), zero(2), wire(c("protocol"), 1), zero(9),
    ]
    return raw.select(F.xxhash64(*raw.columns).alias("datagram_id"), F.timestamp_seconds("received_s").alias("recv_ts"), "exporter_ip", F.lit(2055).alias("port"), F.concat(*head, *body).alias("payload"))


#: Elements and lengths of the template that every datagram below brings along.
IPFIX_TEMPLATE = [(8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (1, 8), (2, 8), (225, 4), (227, 2)]


def datagrams_ipfix(raw: DataFrame) -> DataFrame:
    """A version 10 datagram for every flow, with its template and no times."""
    raw, c = spread(raw), F.col
    fields = b"".join(ie.to_bytes(2, "big") + n.to_bytes(2, "big") for ie, n in IPFIX_TEMPLATE)
    size = sum(n for _, n in IPFIX_TEMPLATE)
    template = (2).to_bytes(2, "big") + (8 + len(fields)).to_bytes(2, "big") + (300).to_bytes(2, "big") + len(IPFIX_TEMPLATE).to_bytes(2, "big") + fields
    head = [wire(10, 2), wire(16 + len(template) + 4 + size, 2), wire(c("received_s"), 4), F.lit(bytes(4)), wire(c("exporter_ip") % 7, 4), F.lit(template), wire(300, 2), wire(4 + size, 2)]
    values = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes", "packets", "nat_public_ip", "nat_public_port"]
    body = [wire(c(v), n) for v, (_, n) in zip(values, IPFIX_TEMPLATE)]
    return raw.select(F.xxhash64(*raw.columns).alias("datagram_id"), F.timestamp_seconds("received_s").alias("recv_ts"), "exporter_ip", F.lit(4739).alias("port"), F.concat(*head, *body).alias("payload"))


def frames_udp(datagrams: DataFrame, files: int) -> DataFrame:
    """Ethernet frames of IPv4 and UDP around the datagrams, for `files` captures by exporter; every third has a VLAN tag."""
    c, size = F.col, F.length("payload")
    tag = F.when(c("exporter_ip") % 3 == 0, F.concat(wire(0x8100, 2), wire(12, 2))).otherwise(F.lit(b""))
    parts = [
        F.lit(bytes(12)), tag, wire(0x0800, 2), wire(0x4500, 2), wire(size + 28, 2), F.lit(bytes(4)), wire(64, 1), wire(17, 1), F.lit(bytes(2)), wire(c("exporter_ip"), 4), wire(X.ip("192.0.2.1"), 4),
        wire(40000, 2), wire(c("port"), 2), wire(size + 8, 2), F.lit(bytes(2)), c("payload"),
    ]
    data = F.concat(*parts)
    return datagrams.select(F.concat(F.lit("capture-"), (c("exporter_ip") % files).cast("string")).alias("file"), c("datagram_id").alias("seq"), c("recv_ts").alias("ts"), F.length(data).alias("orig_len"), F.lit(1).alias("link_type"), data.alias("data"))


#: Elements and lengths of version 9, whose template comes by itself.
V9_TEMPLATE = [(8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (1, 8), (2, 4), (22, 4), (21, 4), (225, 4), (227, 2), (5, 1)]
HALF_HOUR = 1800


def field_bytes(fields: list[tuple[int, int]]) -> bytes:
    return b"".join(ie.to_bytes(2, "big") + n.to_bytes(2, "big") for ie, n in fields)


def datagrams_v9(raw: DataFrame) -> DataFrame:
    """A version 9 datagram for every flow, whose start is 100 s before it was received, and one with the template for each exporter
    and half hour that has flows."""
    raw, c = spread(raw), F.col
    size = sum(n for _, n in V9_TEMPLATE)
    head = lambda at: [wire(9, 2), wire(1, 2), wire(200000, 4), wire(at, 4), F.lit(bytes(4)), wire(7, 4)]
    values = {22: F.lit(100000), 21: 100000 + c("dur_s") * 1000, 5: F.lit(3)} | dict(zip((8, 12, 7, 11, 4, 1, 2, 225, 227), map(c, ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes", "packets", "nat_public_ip", "nat_public_port"))))
    body = [wire(values[ie], n) for ie, n in V9_TEMPLATE]
    row = lambda at, *parts: [F.timestamp_seconds(at).alias("recv_ts"), "exporter_ip", F.lit(2055).alias("port"), F.concat(*head(at), *parts).alias("payload")]
    data = raw.select(F.xxhash64(*raw.columns).alias("datagram_id"), *row(c("received_s"), wire(310, 2), wire(4 + size, 2), *body))
    fields = field_bytes(V9_TEMPLATE)
    slots = raw.select("exporter_ip", (c("received_s") - c("received_s") % HALF_HOUR).alias("slot_s")).distinct()
    # Ids sort before those of data that came in the same second.
    told = slots.select(F.lit(-(2**63)).alias("datagram_id"), *row(c("slot_s"), wire(0, 2), wire(8 + len(fields), 2), wire(310, 2), wire(len(V9_TEMPLATE), 2), F.lit(fields)))
    return data.unionByName(told)


def datagrams_variable(raw: DataFrame) -> DataFrame:
    """A version 10 datagram for every flow, with its template and a name of 0 to 299 bytes between the addresses and the counters."""
    raw, c = spread(raw), F.col
    fields = field_bytes([(8, 4), (12, 4), (82, 65535), (1, 8), (2, 8)])
    template = (2).to_bytes(2, "big") + (8 + len(fields)).to_bytes(2, "big") + (301).to_bytes(2, "big") + (5).to_bytes(2, "big") + fields
    n = c("src_port") % 300
    name = F.concat(F.when(n < 255, wire(n, 1)).otherwise(F.concat(F.lit(b"\xff"), wire(n, 2))), F.encode(F.repeat(F.lit("n"), n.cast("int")), "UTF-8"))
    body = F.concat(wire(c("src_ip"), 4), wire(c("dst_ip"), 4), name, wire(c("bytes"), 8), wire(c("packets"), 8))
    size = F.length(body)
    payload = F.concat(wire(10, 2), wire(20 + len(template) + size, 2), wire(c("received_s"), 4), F.lit(bytes(8)), F.lit(template), wire(301, 2), wire(4 + size, 2), body)
    return raw.select(F.xxhash64(*raw.columns).alias("datagram_id"), F.timestamp_seconds("received_s").alias("recv_ts"), "exporter_ip", F.lit(4739).alias("port"), payload.alias("payload"))


def datagrams_crowded(exporters: DataFrame) -> DataFrame:
    """A version 9 datagram for each device, with two sets of 40 records for each unit of its device_id modulo 128: up to 10,160 records."""
    template = (0).to_bytes(2, "big") + (12).to_bytes(2, "big") + (256).to_bytes(2, "big") + (1).to_bytes(2, "big") + field_bytes([(8, 4)])
    n = 40 * (F.col("device_id") % 128)
    a_set = F.concat(wire(256, 2), wire(4 + 4 * n, 2), F.unhex(F.repeat(F.lit("0A000001"), n.cast("int"))))
    payload = F.concat(wire(9, 2), wire(3, 2), F.lit(bytes(16)), F.lit(template), a_set, a_set)
    return spread(exporters).select(F.col("id").alias("datagram_id"), F.timestamp_seconds(F.lit(AS_OF_S)).alias("recv_ts"), "exporter_ip", F.lit(2055).alias("port"), payload.alias("payload"))


PRIVATE = "({0} BETWEEN 167772160 AND 184549375 OR {0} BETWEEN 2886729728 AND 2887778303 OR {0} BETWEEN 3232235520 AND 3232301055 OR {0} BETWEEN 1681915904 AND 1686110207 OR {0} BETWEEN 2130706432 AND 2147483647 OR {0} BETWEEN 2851995648 AND 2852061183)"


def dotted(c: str) -> str:
    return f"(({c} >> 24) & 255)::VARCHAR || '.' || (({c} >> 16) & 255)::VARCHAR || '.' || (({c} >> 8) & 255)::VARCHAR || '.' || ({c} & 255)::VARCHAR"


def ist_date(s: str) -> str:
    return f"(DATE '1970-01-01' + CAST(({s} + 19800) // 86400 AS INT))"


def ist_clock(s: str) -> str:
    p = f"(({s} + 19800) % 86400)"
    return f"printf('%02d:%02d:%02d', {p} // 3600, {p} % 3600 // 60, {p} % 60)"


#: The same chain in DuckDB, up to flow_logs with start_s, end_s and received_s as epoch seconds.
CTE = f"""
WITH raw_flows AS ({RAW_FLOWS}), devices AS ({DEVICES}), policies AS ({POLICIES}), archived AS ({ARCHIVED}), audit AS ({AUDIT}),
stamped AS (
  SELECT r.*, CASE WHEN d.id IS NULL THEN 'unknown' WHEN d.enabled THEN 'matched' ELSE 'disabled' END AS state,
    coalesce(d.isp_id, 9) AS isp_id, coalesce(d.device_id, 900) AS device_id,
    coalesce(d.skip_dns, true) AS skip_dns, coalesce(d.skip_private, true) AS skip_private, coalesce(d.skip_zero, true) AS skip_zero
  FROM raw_flows r LEFT JOIN devices d USING (exporter_ip)
), reasoned AS (
  SELECT *, CASE WHEN skip_zero AND bytes = 0 THEN 'zero_bytes' WHEN skip_dns AND (src_port = 53 OR dst_port = 53) THEN 'dns'
    WHEN skip_private AND {PRIVATE.format("src_ip")} AND {PRIVATE.format("dst_ip")} THEN 'private_to_private' END AS reason FROM stamped
), started AS (
  SELECT *, CASE WHEN start_off_s BETWEEN -7200 AND 120 THEN received_s + start_off_s ELSE received_s END AS start_s FROM reasoned
), timed AS (
  SELECT *, CASE WHEN received_s + start_off_s + dur_s >= start_s AND received_s + start_off_s + dur_s <= received_s + 120
    THEN received_s + start_off_s + dur_s ELSE start_s END AS end_s, {ist_date("start_s")} AS event_date FROM started
), flow_logs AS (
  SELECT event_date, isp_id, device_id, src_ip, src_port, dst_ip, dst_port, nat_public_ip, nat_public_port, protocol, bytes, packets,
    start_s, end_s, flow_type, exporter_ip, received_s FROM timed WHERE state IN ('matched', 'unknown') AND reason IS NULL
)
"""
