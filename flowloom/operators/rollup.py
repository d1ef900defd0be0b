"""Hourly and subscriber-day rollups whose parts merge on read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import exprs as X

from .aggregates import hours_of, seconds, shares, subscribers_of
from .search import scope_days, today_only

KEYS = ["isp_id", "event_date", "hour", "device_id"]
SUMS = ["flows", "bytes", "packets", "tcp", "udp", "icmp", "other", "dur_sum"]


def rollup_hourly(df: DataFrame) -> DataFrame:
    """Sums and HyperLogLog states of subscribers and public addresses for each tenant, day, hour and device."""
    p = F.col("protocol")
    return df.groupBy("isp_id", "event_date", X.ist_hour(X.epoch(F.col("flow_start"))).alias("hour"), "device_id").agg(
        F.count("*").alias("flows"), F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"),
        F.count_if(p == 6).alias("tcp"), F.count_if(p == 17).alias("udp"), F.count_if(p == 1).alias("icmp"), F.count_if(~p.isin(1, 6, 17)).alias("other"), F.sum(seconds()).alias("dur_sum"),
        F.hll_sketch_agg("src_ip").alias("subs"), F.hll_sketch_agg("nat_public_ip").alias("nat_ips"),
    )


def rollup_subs(df: DataFrame) -> DataFrame:
    return df.groupBy("isp_id", "event_date", "src_ip").agg(F.sum("bytes").alias("bytes"))


def merge_rollup(parts: DataFrame) -> DataFrame:
    """Parts of equal keys, from several batches, as one row each."""
    return parts.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS], F.hll_union_agg("subs").alias("subs"), F.hll_union_agg("nat_ips").alias("nat_ips"))


def merge_subs(parts: DataFrame) -> DataFrame:
    return parts.groupBy("isp_id", "event_date", "src_ip").agg(F.sum("bytes").alias("bytes"))


def scalars(rollup: DataFrame, isp: int, days: int, as_of: str) -> DataFrame:
    """As the raw dashboard scalars: devices exact, subscribers and public addresses estimated."""
    return scope_days(rollup, isp, days, as_of).agg(
        F.coalesce(F.sum("flows"), F.lit(0)).alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("subs")).alias("subscribers"), F.count_distinct("device_id").alias("devices"), F.sum("bytes").alias("bytes"),
        F.hll_sketch_estimate(F.hll_union_agg("nat_ips")).alias("nat_ips"), F.floor(F.coalesce(F.sum("dur_sum"), F.lit(0)) / F.greatest(F.sum("flows"), F.lit(1))).alias("mean_s"),
    )


def today(rollup: DataFrame, isp: int, as_of: str) -> DataFrame:
    return today_only(rollup, as_of, isp).agg(F.coalesce(F.sum("flows"), F.lit(0)).alias("n"))


def hourly_today(rollup: DataFrame, isp: int, as_of: str) -> DataFrame:
    return hours_of(today_only(rollup, as_of, isp).groupBy("hour").agg(F.sum("flows").alias("flows")), rollup.sparkSession)


def top_devices(rollup: DataFrame, isp: int, days: int, as_of: str, limit: int = 7) -> DataFrame:
    totals = scope_days(rollup, isp, days, as_of).groupBy("device_id").agg(F.sum("flows").alias("flows"))
    return totals.orderBy(F.desc("flows"), "device_id").limit(limit).select(F.concat(F.lit("DEV-"), F.col("device_id").cast("string")).alias("device"), "flows")


def top_subscribers(subs: DataFrame, isp: int, days: int, as_of: str, limit: int = 5) -> DataFrame:
    return subscribers_of(scope_days(subs, isp, days, as_of).groupBy("src_ip").agg(F.sum("bytes").alias("bytes")), limit)


def proto_mix(rollup: DataFrame, isp: int, days: int, as_of: str) -> DataFrame:
    sums = scope_days(rollup, isp, days, as_of).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tcp", "udp", "icmp", "other")])
    return shares(sums.select(F.expr("stack(4, 'TCP', tcp, 'UDP', udp, 'ICMP', icmp, 'OTH', other) AS (name, flows)")))


def rollup_tick(df: DataFrame, after_s: int, cutoff_s: int) -> DataFrame:
    """The rows of one batch tick: created after the watermark up to the cut-off; none if that isn't later."""
    return df.filter((F.col("created_at") > X.at_epoch(F.lit(after_s))) & (F.col("created_at") <= X.at_epoch(F.lit(cutoff_s))))


def backfill(df: DataFrame, cutoff_s: int) -> tuple[DataFrame, DataFrame]:
    """The first run: both rollups of everything created up to the cut-off, which becomes the watermark."""
    rows = df.filter(F.col("created_at") <= X.at_epoch(F.lit(cutoff_s)))
    return rollup_hourly(rows), rollup_subs(rows)
