"""From decoded flows to stored ones: registry join, admission, clock guard and skip rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from flowloom.functions import exprs as X

BROADCAST_ROWS = 500_000
RULES = ["skip_dns", "skip_private", "skip_zero"]
GLOBAL_RULES = {"skip_dns": True, "skip_private": True, "skip_zero": True}
#: Fixed values, in seconds: a start further back than this, or further ahead, is the exporter's clock at fault.
PAST_S, AHEAD_S = 7200, 120
#: All that can become of a flow, by the names of states and reasons.
OUTCOMES = [*[(s, r) for s in ("matched", "unknown") for r in ("kept", "zero_bytes", "dns", "private_to_private")], ("disabled", ""), ("rejected", "")]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; else it is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_registry(flows: DataFrame, devices: DataFrame) -> DataFrame:
    """Flows with the device of their exporter, unmatched ones with nulls; dev_* columns."""
    side = devices.select(F.col("exporter_ip"), *[F.col(c).alias(f"dev_{c}") for c in devices.columns if c != "exporter_ip"])
    return flows.join(small(side), "exporter_ip", "left")


def effective_rules(devices: DataFrame, rules: dict[str, bool] | None = None) -> DataFrame:
    """Devices with each rule flag set: their own, or the global one where they have none."""
    rules = GLOBAL_RULES | (rules or {})
    return devices.withColumns({r: F.coalesce(F.col(r), F.lit(rules[r])) for r in RULES})


def stamp_identity(flows: DataFrame, devices: DataFrame, mode: str = "allow", default_isp: int = 9, default_device: int = 900, rules: dict[str, bool] | None = None) -> DataFrame:
    """Flows with state, isp_id, device_id and the rule flags in force.

    state: matched, disabled, unknown or rejected (unknown under mode reject). Unknown exporters take the
    defaults under mode allow and 0/0 under mode observe, with the global rules in both.
    """
    rules = GLOBAL_RULES | (rules or {})
    joined = join_registry(flows, effective_rules(devices, rules))
    known = F.col("dev_device_id").isNotNull()
    isp, dev = (default_isp, default_device) if mode == "allow" else (0, 0)
    state = F.when(known & F.col("dev_enabled"), "matched").when(known, "disabled").otherwise("rejected" if mode == "reject" else "unknown")
    return joined.withColumns(
        {"state": state, "isp_id": F.coalesce("dev_isp_id", F.lit(isp)).cast("int"), "device_id": F.coalesce("dev_device_id", F.lit(dev)).cast("int")}
        | {r: F.coalesce(f"dev_{r}", F.lit(rules[r])) for r in RULES}
    ).drop(*[c for c in joined.columns if c.startswith("dev_")])


def admit(stamped: DataFrame) -> DataFrame:
    """Flows of matched and of unknown exporters that the mode lets in."""
    return stamped.filter(F.col("state").isin("matched", "unknown"))


def normalize_times(flows: DataFrame, start: Column | None = None, end: Column | None = None, now: Column | None = None) -> DataFrame:
    """Sets start_s and end_s, epoch seconds: a missing or impossible start is the receive time, a missing
    end, or one before the start or ahead of the clock, is the start."""
    now = F.col("received_s") if now is None else now
    start = F.col("received_s") + F.col("start_off_s") if start is None else start
    end = start + F.col("dur_s") if end is None else end
    good = F.when(start.between(now - PAST_S, now + AHEAD_S), start).otherwise(now)
    out = flows.withColumn("start_s", good)
    return out.withColumn("end_s", F.when((end >= F.col("start_s")) & (end <= now + AHEAD_S), end).otherwise(F.col("start_s")))


def skip_reason(both_private: Column | None = None) -> Column:
    """The first rule that a flow breaks, else null.

    both_private says whether both ends are private, for flows whose addresses of other kinds than IPv4 are gone.
    """
    private = X.is_private(F.col("src_ip")) & X.is_private(F.col("dst_ip"))
    return (
        F.when(F.col("skip_zero") & X.is_zero_bytes(F.col("bytes")), "zero_bytes")
        .when(F.col("skip_dns") & X.is_dns(F.col("src_port"), F.col("dst_port")), "dns")
        .when(F.col("skip_private") & (private if both_private is None else both_private), "private_to_private")
    )


def reason_of(flows: DataFrame) -> Column:
    """skip_reason for these flows: decoded ones bring the column both_private, which was judged on the wire's addresses."""
    return skip_reason(F.col("both_private") if "both_private" in flows.columns else None)


def with_skip_reason(flows: DataFrame) -> DataFrame:
    return flows.withColumn("skip_reason", reason_of(flows))


def apply_skip_rules(flows: DataFrame) -> DataFrame:
    """Flows that no rule skips."""
    return flows.filter(reason_of(flows).isNull())


def with_flow_type(flows: DataFrame, version: str = "version") -> DataFrame:
    v = F.col(version)
    return flows.withColumn("flow_type", F.when(v == 5, "netflow5").when(v == 9, "netflow9").when(v == 10, "ipfix"))


def with_event_date(flows: DataFrame) -> DataFrame:
    return flows.withColumn("event_date", X.ist_date(F.col("start_s")))


def to_flow_logs(flows: DataFrame) -> DataFrame:
    """The stored columns of normalized, stamped flows; created_at is the receive time."""
    out = with_event_date(flows).withColumns({"flow_start": X.at_epoch(F.col("start_s")), "flow_end": X.at_epoch(F.col("end_s")), "created_at": X.at_epoch(F.col("received_s"))})
    return out.select(
        "event_date", "isp_id", "device_id", "src_ip", "src_port", "dst_ip", "dst_port", "nat_public_ip", "nat_public_port", "protocol", "bytes", "packets",
        "flow_start", "flow_end", "flow_type", "exporter_ip", "created_at",
    )


def outcome_of(stamped: DataFrame) -> Column:
    """`kept`, the rule that skips a flow, or empty for flows that aren't admitted."""
    return F.when(F.col("state").isin("matched", "unknown"), F.coalesce(reason_of(stamped), F.lit("kept"))).otherwise("")


def ingest(raw: DataFrame, devices: DataFrame, mode: str = "allow", watch: Observation | None = None, **options) -> DataFrame:
    """Decoded flows to flow_logs in one plan; the registry join is the only join and nothing shuffles.

    `watch` takes the numbers of accounting() on the way, when the result is written; outcomes() makes rows of them.
    """
    stamped = stamp_identity(raw, devices, mode, **options)
    if watch is not None:
        met = {f"{s}/{r}": (F.col("state") == s) & (outcome_of(stamped) == r) for s, r in OUTCOMES}
        counted = [F.count_if(c).alias(f"{n}/flows") for n, c in met.items()] + [F.sum(F.when(c, F.col("bytes"))).alias(f"{n}/bytes") for n, c in met.items()]
        stamped = stamped.observe(watch, *counted)
    return to_flow_logs(apply_skip_rules(normalize_times(admit(stamped))))


def outcomes(watched: dict[str, int]) -> list[tuple[str, str, int, int | None]]:
    """(state, reason, flows, bytes) of what an observation of ingest() took, without those that didn't occur."""
    return [(s, r, watched[f"{s}/{r}/flows"], watched[f"{s}/{r}/bytes"]) for s, r in OUTCOMES if watched.get(f"{s}/{r}/flows")]


def accounting(raw: DataFrame, devices: DataFrame, mode: str = "allow", **options) -> DataFrame:
    """(state, skip_reason, flows, bytes): what became of every flow; `kept` for those that are stored."""
    stamped = stamp_identity(raw, devices, mode, **options)
    return stamped.withColumn("reason", outcome_of(stamped)).groupBy("state", "reason").agg(F.count("*").alias("flows"), F.sum("bytes").alias("bytes"))


def rates(outcomes: DataFrame, ts: str = "ts", outcome: str = "outcome", width: str = "1 minute") -> DataFrame:
    """(window_start, outcome, n) in tumbling windows; works on streams and tables."""
    return outcomes.groupBy(F.window(ts, width).alias("w"), outcome).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), outcome, "n")


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with a reason): a bad row never takes its batch along."""
    reason = (
        F.when(F.col("flow_start").isNull() | F.col("flow_end").isNull(), "no time")
        .when(F.col("src_ip").isNull() | ~F.col("src_ip").between(0, 4294967295), "bad source address")
        .when(F.col("dst_ip").isNull() | ~F.col("dst_ip").between(0, 4294967295), "bad destination address")
        .when(~F.col("src_port").between(0, 65535) | ~F.col("dst_port").between(0, 65535) | ~F.col("nat_public_port").between(0, 65535), "bad port")
        .when(~F.col("protocol").between(0, 255), "bad protocol")
        .when((F.col("bytes") < 0) | (F.col("packets") < 0), "negative counter")
    )
    marked = df.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def dedup_flows(flows: DataFrame, key: list[str] | None = None, watermark: str | None = None) -> DataFrame:
    """One row per key, for at-least-once delivery; on streams within the watermark of created_at."""
    from flowloom.schemas import FLOW_KEY

    key = key or [*FLOW_KEY, "exporter_ip", "protocol", "bytes"]
    if flows.isStreaming:
        return flows.withWatermark("created_at", watermark or "10 minutes").dropDuplicatesWithinWatermark(key)
    return flows.dropDuplicates(key)
