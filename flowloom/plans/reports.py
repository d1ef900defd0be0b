"""Composite reports: what one page of the console or one export needs, as named DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import exprs as X
from flowloom.operators import aggregates as A
from flowloom.operators import ingest as I
from flowloom.operators import lifecycle as L
from flowloom.operators import liveness as V
from flowloom.operators import onepass as O
from flowloom.operators import registry as G
from flowloom.operators import rollup as R
from flowloom.operators import search as S


def dashboard(flows: DataFrame, isp: int, days: int, as_of: str) -> dict[str, DataFrame]:
    """Six sections from one scan, exact; the newest records from one of their own, which reads other columns and keeps 50 rows a task."""
    place = F.array_position(F.array(*map(F.lit, A.CLASSES)), X.protocol_name(F.col("protocol")))
    hour = F.when(F.col("event_date") == F.lit(as_of).cast("date"), X.ist_hour(X.epoch(F.col("flow_start"))))
    keys = {"protocol": place, "hour": hour, "device": F.col("device_id"), "subscriber": F.col("src_ip"), "nat_ip": F.col("nat_public_ip")}
    sums = {"bytes": F.col("bytes"), "seconds": A.seconds()}
    page = O.grouped_once(S.scope_days(flows, isp, days, as_of), keys, sums, {"subscriber": "bytes"}, 24)
    count = lambda key, column: F.coalesce(O.total(key, column), F.lit(0).cast("long"))
    rows = count("protocol", "flows")
    hours = O.largest(page, "hour").select(F.col("key").cast("int").alias("hour"), "flows")
    return {
        "scalars": page.select(
            rows.alias("rows"), count("subscriber", "n").alias("subscribers"), count("device", "n").alias("devices"), O.total("protocol", "bytes").alias("bytes"), count("nat_ip", "n").alias("nat_ips"),
            F.floor(count("protocol", "seconds") / F.greatest(rows, F.lit(1))).alias("mean_s"),
        ),
        "today": hours.agg(F.coalesce(F.sum("flows"), F.lit(0)).alias("n")), "hourly": A.hours_of(hours, flows.sparkSession),
        "protocols": A.shares(O.largest(page, "protocol").select(F.element_at(F.array(*map(F.lit, A.CLASSES)), F.col("key").cast("int")).alias("name"), "flows")),
        "devices": O.largest(page, "device", 7).select(F.concat(F.lit("DEV-"), F.col("key").cast("string")).alias("device"), "flows"),
        "subscribers": A.subscribers_of(O.largest(page, "subscriber", 5).select(F.col("key").alias("src_ip"), "bytes"), 5), "records": S.recent_records(flows, isp, days, as_of, 50),
    }


def dashboard_from_rollup(hourly: DataFrame, subs: DataFrame, flows: DataFrame, isp: int, days: int, as_of: str) -> dict[str, DataFrame]:
    """The same from the rollups, records from the hot table; from the hot table alone while the rollups are empty."""
    if S.scope_days(hourly, isp, days, as_of).isEmpty():
        return dashboard(flows, isp, days, as_of)
    return {
        "scalars": R.scalars(hourly, isp, days, as_of), "today": R.today(hourly, isp, as_of), "hourly": R.hourly_today(hourly, isp, as_of), "protocols": R.proto_mix(hourly, isp, days, as_of),
        "devices": R.top_devices(hourly, isp, days, as_of), "subscribers": R.top_subscribers(subs, isp, days, as_of), "records": S.recent_records(flows, isp, days, as_of, 50),
    }


def flows_page(flows: DataFrame, isp: int, days: int, as_of: str) -> dict[str, DataFrame]:
    return {"summary": A.summary(flows, isp, days, as_of), "talkers": A.top_talkers(flows, isp, days, as_of, 10), "devices": A.per_device(flows, isp, days, as_of), "recent": S.recent(flows, isp, days, as_of, 25)}


def search_page(flows: DataFrame, cold: DataFrame | None, devices: DataFrame, f: S.SearchFilter, limit: int = 50, offset: int = 0, audit=None, count_cap: int | None = S.COUNT_CAP) -> dict[str, DataFrame]:
    """Records with device names and the total, capped unless count_cap is None; the lookup is handed to `audit` on the first page only."""
    rows = S.page_merged(flows, cold, f, limit, offset) if cold is not None else S.search_page(flows, f, limit, offset)
    total = S.search_all(flows, cold, f).agg(F.count("*").alias("n")) if cold is not None else S.search_count(flows, f, count_cap)
    if audit and S.page_bounds(limit, offset)[1] == 0:
        audit(f)
    capped = F.lit(False) if count_cap is None else F.col("n") >= count_cap
    return {"records": S.name_devices(rows, devices), "total": total.withColumn("capped", capped)}


def disclosure(flows: DataFrame, cold: DataFrame | None, devices: DataFrame, f: S.SearchFilter, cap: int | None = S.SEARCH_CAP, audit=None) -> dict[str, DataFrame]:
    """The cells of an IP detail report, newest first, and whether the cap cut it; all of them without a cap."""
    rows = S.name_devices(S.search_all(flows, cold, f, cap), devices)
    rows = rows.orderBy(F.desc("time"), *[F.col(c) for c in sorted(rows.columns) if c != "time"])
    rows = rows if cap is None else rows.limit(cap)
    if audit:
        audit(f)
    return {"cells": S.project_report(rows), "truncated": rows.agg((F.lit(False) if cap is None else F.count("*") == cap).alias("truncated"))}


def retention_page(flows: DataFrame, archived: DataFrame, isp: int) -> dict[str, DataFrame]:
    return {"storage": A.tenant_storage(flows, isp), "window": A.retention_window(flows, isp), "days": A.per_day(flows, isp, 30), "archived": L.list_archived_days(archived)}


def overview(flows: DataFrame, raw: DataFrame, devices: DataFrame, isp: int, as_of: str) -> dict[str, DataFrame]:
    return {"today": A.count_today(flows, isp, as_of), "storage": A.tenant_storage(flows, isp), "accounting": I.accounting(raw, devices), "exporters": G.active_exporters(devices, isp)}


def device_list(flows: DataFrame, devices: DataFrame, as_of_s: int, silence_s: int = 900) -> DataFrame:
    health = V.device_health(devices, A.last_seen(flows, 3, as_of_s), as_of_s, silence_s)
    return devices.join(health.drop("exporter_ip"), ["isp_id", "id"])


def stacked(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts as (section, row): each row as JSON with sorted names, for comparing reports as one table."""
    rows = [p.select(F.lit(name).alias("section"), F.to_json(F.struct(*sorted(p.columns))).alias("row")) for name, p in parts.items()]
    return reduce(DataFrame.unionByName, rows)
