"""Summaries and top lists over flow_logs. Each is one partial and one final aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import exprs as X

from .search import scope_days, today_only

CLASSES = ["TCP", "UDP", "ICMP", "OTH"]


def distinct_count(column: str, exact: bool = True) -> Column:
    """Exact, or a HyperLogLog estimate with an error of about 1.6 %."""
    return F.count_distinct(column) if exact else F.approx_count_distinct(column, 0.016)


def seconds() -> Column:
    return X.epoch(F.col("flow_end")) - X.epoch(F.col("flow_start"))


def summary(df: DataFrame, isp: int, days: int, as_of: str, exact: bool = True) -> DataFrame:
    return scope_days(df, isp, days, as_of).agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), distinct_count("device_id", exact).alias("devices"))


def top_talkers(df: DataFrame, isp: int, days: int, as_of: str, limit: int = 10) -> DataFrame:
    totals = scope_days(df, isp, days, as_of).groupBy("src_ip").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("flows"))
    return totals.orderBy(F.desc("bytes"), "src_ip").limit(limit).select(X.inet_ntoa(F.col("src_ip")).alias("src_ip"), "bytes", "flows")


def per_device(df: DataFrame, isp: int, days: int, as_of: str, limit: int = 200) -> DataFrame:
    totals = scope_days(df, isp, days, as_of).groupBy("isp_id", "device_id").agg(F.count("*").alias("flows"), F.sum("bytes").alias("bytes"))
    return totals.orderBy(F.desc("bytes"), "isp_id", "device_id").limit(limit)


def last_seen(df: DataFrame, days: int, as_of_s: int) -> DataFrame:
    """(isp_id, exporter_ip, last_s) within so many days."""
    since = as_of_s - 86400 * days
    recent = df.filter((F.col("event_date") >= F.date_sub(X.ist_date(F.lit(as_of_s)), days)) & (F.col("flow_start") > X.at_epoch(F.lit(since))))
    return recent.groupBy("isp_id", "exporter_ip").agg(X.epoch(F.max("flow_start")).alias("last_s"))


def dashboard_scalars(df: DataFrame, isp: int, days: int, as_of: str, exact: bool = True) -> DataFrame:
    return scope_days(df, isp, days, as_of).agg(
        F.count("*").alias("rows"), distinct_count("src_ip", exact).alias("subscribers"), distinct_count("device_id", exact).alias("devices"), F.sum("bytes").alias("bytes"),
        distinct_count("nat_public_ip", exact).alias("nat_ips"), F.floor(F.coalesce(F.sum(seconds()), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("mean_s"),
    )


def count_today(df: DataFrame, isp: int, as_of: str) -> DataFrame:
    return today_only(df, as_of, isp).agg(F.count("*").alias("n"))


def day_health(df: DataFrame, as_of: str) -> DataFrame:
    return df.filter(F.col("event_date") >= F.lit(as_of).cast("date")).agg(F.count("*").alias("n"))


def hours_of(counts: DataFrame, spark) -> DataFrame:
    """(hour, flows) for all 24 hours, 0 where there are none."""
    return spark.range(24).select(F.col("id").cast("int").alias("hour")).join(F.broadcast(counts), "hour", "left").select("hour", F.coalesce("flows", F.lit(0)).alias("flows"))


def hourly_today(df: DataFrame, isp: int, as_of: str) -> DataFrame:
    return hours_of(today_only(df, as_of, isp).groupBy(X.ist_hour(X.epoch(F.col("flow_start"))).alias("hour")).agg(F.count("*").alias("flows")), df.sparkSession)


def shares(counts: DataFrame) -> DataFrame:
    """(name, pct) of (name, flows), classes without flows left out; the order of classes is fixed."""
    whole = counts.agg(F.sum("flows").alias("whole"))
    place = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("name")).cast("int")
    return counts.crossJoin(F.broadcast(whole)).filter("flows > 0").select(place.alias("place"), "name", X.round1(F.col("flows") / F.col("whole") * 100).alias("pct"))


def proto_mix(df: DataFrame, isp: int, days: int, as_of: str) -> DataFrame:
    return shares(scope_days(df, isp, days, as_of).groupBy(X.protocol_name(F.col("protocol")).alias("name")).agg(F.count("*").alias("flows")))


def top_devices(df: DataFrame, isp: int, days: int, as_of: str, limit: int = 7) -> DataFrame:
    totals = scope_days(df, isp, days, as_of).groupBy("device_id").agg(F.count("*").alias("flows"))
    return totals.orderBy(F.desc("flows"), "device_id").limit(limit).select(F.concat(F.lit("DEV-"), F.col("device_id").cast("string")).alias("device"), "flows")


def subscribers_of(totals: DataFrame, limit: int) -> DataFrame:
    """(label, value, pct) of the largest of (src_ip, bytes), percent of the first."""
    top = totals.orderBy(F.desc("bytes"), "src_ip").limit(limit)
    most = top.agg(F.max("bytes").alias("most"))
    return top.crossJoin(F.broadcast(most)).select(X.inet_ntoa(F.col("src_ip")).alias("label"), X.human_bytes(F.col("bytes")).alias("value"), X.percent(F.col("bytes"), F.col("most")).alias("pct"))


def top_subscribers(df: DataFrame, isp: int, days: int, as_of: str, limit: int = 5) -> DataFrame:
    return subscribers_of(scope_days(df, isp, days, as_of).groupBy("src_ip").agg(F.sum("bytes").alias("bytes")), limit)


def tenant_storage(df: DataFrame, isp: int) -> DataFrame:
    return df.filter(F.col("isp_id") == isp).agg(F.count("*").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def retention_window(df: DataFrame, isp: int = 0) -> DataFrame:
    rows = df.filter(F.col("isp_id") == isp) if isp else df
    return rows.agg(F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"))


def per_day(df: DataFrame, isp: int = 0, n: int = 30) -> DataFrame:
    rows = df.filter(F.col("isp_id") == isp) if isp else df
    return rows.groupBy("event_date").agg(F.count("*").alias("flows")).orderBy(F.desc("event_date")).limit(n)


def days_older_than(df: DataFrame, after: int, as_of: str) -> DataFrame:
    return df.filter(F.col("event_date") < F.date_sub(F.lit(as_of).cast("date"), after)).select("event_date").distinct()


def archive_counts(df: DataFrame, day: str) -> DataFrame:
    return df.filter(F.col("event_date") == F.lit(day).cast("date")).groupBy("isp_id").agg(F.count("*").alias("rows"))


def daily_summary(df: DataFrame, n: int = 14) -> DataFrame:
    """The newest days with rows, first and last start, and bytes for people."""
    days = df.groupBy("event_date").agg(F.count("*").alias("rows"), X.epoch(F.min("flow_start")).alias("first_s"), X.epoch(F.max("flow_start")).alias("last_s"), F.sum("bytes").alias("bytes"))
    return days.orderBy(F.desc("event_date")).limit(n).withColumn("volume", X.human_bytes(F.col("bytes")))


def flow_types_by_device(df: DataFrame, device: int) -> DataFrame:
    return df.filter(F.col("device_id") == device).groupBy("flow_type").agg(F.count("*").alias("flows"))


def device_probe(df: DataFrame, device: int, flow_type: str | None = None) -> DataFrame:
    rows = df.filter(F.col("device_id") == device)
    rows = rows.filter(F.col("flow_type") == flow_type) if flow_type else rows
    return rows.agg(F.count("*").alias("flows"), X.epoch(F.max("flow_start")).alias("last_s"))
