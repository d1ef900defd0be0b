"""Searches over hot and cold flows, pages and the records that they show."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import exprs as X

from .ingest import small

log = logging.getLogger(__name__)
#: Rows that a page counts, and that a search shows, unless told otherwise; a cap of None cuts nothing.
COUNT_CAP, SEARCH_CAP = 100_000, 5_000


class TenantError(PermissionError):
    """A request for rows of another tenant."""


@dataclass
class SearchFilter:
    """Unset or unknown values set no condition; times are epoch seconds."""

    isp_id: int = 0
    public_ip: str = ""
    private_ip: str = ""
    dest_ip: str = ""
    public_port: int = 0
    proto: str = ""
    device_id: int = 0
    from_s: int | None = None
    to_s: int | None = None

    def has_selector(self) -> bool:
        return bool(self.public_ip or self.private_ip or self.dest_ip or self.device_id)


def scope_isp(df: DataFrame, role: str, own: int | None, requested: int = 0) -> DataFrame:
    """Rows of the tenant that the user may see: a director any or all (0), others their own only."""
    if role != "director":
        if not own:
            raise TenantError("the user has no tenant")
        if requested not in (0, own):
            raise TenantError("rows of another tenant")
        requested = own
    return df.filter(F.col("isp_id") == requested) if requested else df


def scope_days(df: DataFrame, isp: int, days: int, as_of: str) -> DataFrame:
    """The day window, both ends included, and optionally one tenant."""
    out = df.filter(F.col("event_date") >= F.date_sub(F.lit(as_of).cast("date"), days))
    return out.filter(F.col("isp_id") == isp) if isp else out


def today_only(df: DataFrame, as_of: str, isp: int = 0) -> DataFrame:
    out = df.filter(F.col("event_date") == F.lit(as_of).cast("date"))
    return out.filter(F.col("isp_id") == isp) if isp else out


def recent_flows(df: DataFrame, as_of_s: int, hours: int = 3) -> DataFrame:
    """Flows that started within so many hours, with a day bound so that partitions are pruned."""
    return df.filter((F.col("event_date") >= F.date_sub(X.ist_date(F.lit(as_of_s - 3600 * hours)), 0)) & (F.col("flow_start") > X.at_epoch(F.lit(as_of_s - 3600 * hours))))


def bound_partitions(from_s: int | None, to_s: int | None) -> Column:
    """Day bounds, a day wide of the exact ones, next to exact time bounds."""
    out = F.lit(True)
    if from_s is not None:
        out = out & (F.col("flow_start") >= X.at_epoch(F.lit(from_s))) & (F.col("event_date") >= F.date_sub(X.ist_date(F.lit(from_s)), 1))
    if to_s is not None:
        out = out & (F.col("flow_start") <= X.at_epoch(F.lit(to_s))) & (F.col("event_date") <= F.date_add(X.ist_date(F.lit(to_s)), 1))
    return out


def search(df: DataFrame, f: SearchFilter) -> DataFrame:
    """Hot rows that meet every condition; refused without an address or a device."""
    if not f.has_selector():
        raise ValueError("a search needs an address or a device")
    for column, text in (("nat_public_ip", f.public_ip), ("src_ip", f.private_ip), ("dst_ip", f.dest_ip)):
        if text:
            df = df.filter(F.col(column) == X.ip(text))
    for column, n in (("nat_public_port", f.public_port), ("protocol", X.PROTOCOLS.get(f.proto.upper(), 0)), ("device_id", f.device_id), ("isp_id", f.isp_id)):
        if n > 0:
            df = df.filter(F.col(column) == n)
    return df.filter(bound_partitions(f.from_s, f.to_s))


def search_cold(cold: DataFrame, f: SearchFilter) -> DataFrame:
    """The same over archived rows, whose addresses are dotted text and whose times start_s, end_s may be null."""
    if not f.has_selector():
        raise ValueError("a search needs an address or a device")
    for column, text in (("nat_public_ip", f.public_ip), ("src_ip", f.private_ip), ("dst_ip", f.dest_ip)):
        if text:
            cold = cold.filter(F.col(column) == text)
    for column, n in (("nat_public_port", f.public_port), ("protocol", X.PROTOCOLS.get(f.proto.upper(), 0)), ("device_id", f.device_id), ("isp_id", f.isp_id)):
        if n > 0:
            cold = cold.filter(F.col(column) == n)
    if f.from_s is not None:
        cold = cold.filter(F.col("start_s") >= f.from_s)
    if f.to_s is not None:
        cold = cold.filter(F.col("start_s") <= f.to_s)
    return cold


def project_search(df: DataFrame) -> DataFrame:
    """Search records: times in IST, endpoints as text, the public one blank where nothing was translated."""
    s = X.epoch(F.col("flow_start"))
    shown = X.has_translation(F.col("src_ip"), F.col("src_port"), F.col("nat_public_ip"), F.col("nat_public_port"))
    return df.select(
        X.ist_date(s).cast("string").alias("date"), X.ist_clock(s).alias("clock"), X.ist_text(s).alias("time"), F.concat(F.lit("DEV-"), F.col("device_id").cast("string")).alias("sub"), "device_id",
        X.inet_ntoa(F.col("src_ip")).alias("priv_ip"), F.col("src_port").alias("priv_port"), F.when(shown, X.inet_ntoa(F.col("nat_public_ip"))).otherwise("").alias("pub_ip"), F.when(shown, F.col("nat_public_port")).otherwise(0).alias("pub_port"),
        X.protocol_name(F.col("protocol")).alias("proto"), X.inet_ntoa(F.col("dst_ip")).alias("dst_ip"), F.col("dst_port"),
        F.concat_ws(":", X.inet_ntoa(F.col("dst_ip")), F.col("dst_port").cast("string")).alias("dest"), F.upper("flow_type").alias("action"),
    )


def project_record(df: DataFrame) -> DataFrame:
    """Dashboard records: as search records, the destination without its port."""
    return project_search(df).withColumn("dest", F.col("dst_ip")).drop("dst_ip", "dst_port")


def project_recent(df: DataFrame) -> DataFrame:
    return df.select(
        X.epoch(F.col("flow_start")).alias("start_s"), "isp_id", "device_id", X.inet_ntoa(F.col("src_ip")).alias("src_ip"), "src_port", X.inet_ntoa(F.col("nat_public_ip")).alias("nat_public_ip"), "nat_public_port",
        X.inet_ntoa(F.col("dst_ip")).alias("dst_ip"), "dst_port", X.protocol_name(F.col("protocol")).alias("proto"),
    )


def project_report(records: DataFrame) -> DataFrame:
    """The eight cells of a disclosure report, safe for spreadsheets."""
    cells = {
        "src_ip": F.col("priv_ip"), "src_port": X.port_or_blank(F.col("priv_port")), "dst_ip": F.col("dst_ip"), "dst_port": X.port_or_blank(F.col("dst_port")),
        "nat_ip": F.col("pub_ip"), "nat_port": X.port_or_blank(F.col("pub_port")), "timestamp": F.col("time"), "proto": F.col("proto"),
    }
    return records.select(*[X.formula_safe(c).alias(n) for n, c in cells.items()])


def newest(df: DataFrame) -> list[Column]:
    """Newest first, ties by all columns, so that pages are the same each time."""
    return [F.desc("flow_start"), *[F.col(c) for c in sorted(df.columns) if c != "flow_start"]]


def newest_of(df: DataFrame, cap: int | None) -> DataFrame:
    """The newest rows up to the cap; all of them, in no order, without one."""
    return df if cap is None else df.orderBy(*newest(df)).limit(cap)


def search_count(df: DataFrame, f: SearchFilter, cap: int | None = COUNT_CAP) -> DataFrame:
    """(n): matching rows, counted no further than the cap, if there is one."""
    found = search(df, f)
    return (found if cap is None else found.limit(cap)).agg(F.count("*").alias("n"))


def page_bounds(limit: int, offset: int) -> tuple[int, int]:
    return (limit if 1 <= limit <= 200 else 50), max(offset, 0)


def search_page(df: DataFrame, f: SearchFilter, limit: int = 50, offset: int = 0) -> DataFrame:
    limit, offset = page_bounds(limit, offset)
    found = search(df, f)
    return project_search(found.orderBy(*newest(found)).offset(offset).limit(limit))


def recent(df: DataFrame, isp: int, days: int, as_of: str, limit: int = 25) -> DataFrame:
    rows = scope_days(df, isp, days, as_of)
    return project_recent(rows.orderBy(*newest(rows)).limit(limit))


def recent_records(df: DataFrame, isp: int, days: int, as_of: str, limit: int = 50) -> DataFrame:
    rows = scope_days(df, isp, days, as_of)
    return project_record(rows.orderBy(*newest(rows)).limit(limit))


def latest_inserted(df: DataFrame, limit: int = 5) -> DataFrame:
    return df.orderBy(F.desc("created_at"), *[F.col(c) for c in sorted(df.columns) if c != "created_at"]).limit(limit)


def report_rows(df: DataFrame, f: SearchFilter, cap: int = SEARCH_CAP) -> DataFrame:
    """Report cells of the newest rows up to the cap, each with `truncated`: whether the cap was reached."""
    found = search(df, f)
    rows = found.orderBy(*newest(found)).limit(cap)
    full = rows.agg((F.count("*") == cap).alias("truncated"))
    return project_report(project_search(rows)).crossJoin(F.broadcast(full))  # one row


def name_devices(records: DataFrame, devices: DataFrame) -> DataFrame:
    """Records whose `sub` is the device's name: the last by (isp_id, id) that isn't blank; else DEV-n stays."""
    names = devices.filter(F.coalesce("name", F.lit("")) != "").groupBy("device_id").agg(F.max_by("name", F.struct("isp_id", "id")).alias("_name"))
    return records.join(small(names), "device_id", "left").withColumn("sub", F.coalesce("_name", "sub")).drop("_name").select(*records.columns)


def archived_days_in_range(days: DataFrame, from_s: int | None, to_s: int | None) -> DataFrame:
    """Archived days that overlap a window; days are IST midnights, open ends match all."""
    start = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long") * 86400 - X.IST
    if from_s is not None:
        days = days.filter(start + 86400 > from_s)
    if to_s is not None:
        days = days.filter(start <= to_s)
    return days


def cold_records(cold: DataFrame, f: SearchFilter, cap: int | None = SEARCH_CAP) -> DataFrame:
    """The newest `cap` records among archived rows; all without a cap."""
    old = search_cold(cold, f).withColumn("flow_start", X.at_epoch(F.col("start_s")))
    for c in ("src_ip", "dst_ip", "nat_public_ip"):
        old = old.withColumn(c, X.inet_aton(F.col(c)))
    return project_search(newest_of(old, cap))


def search_all(hot: DataFrame, cold: DataFrame | None, f: SearchFilter, cap: int | None = SEARCH_CAP, dedup: bool = False) -> DataFrame:
    """Records of hot and cold matches, the newest `cap` of each, or all (None); a day in both is there twice unless dedup."""
    out = project_search(newest_of(search(hot, f), cap))
    if cold is not None:
        out = out.unionByName(cold_records(cold, f, cap))
    return out.distinct() if dedup else out


def search_all_or_hot(hot: DataFrame, read_cold: Callable[[], DataFrame], f: SearchFilter, cap: int = SEARCH_CAP) -> tuple[DataFrame, bool]:
    """(search_all(), whether the archive took part): hot matches alone if the archive can't be read, when planned or when run.

    The archive's records, at most `cap`, are fetched here, since a file may turn out to be damaged only then.
    """
    found = search_all(hot, None, f, cap)
    try:
        old = cold_records(read_cold(), f, cap)
        rows = old.collect()
    except Exception as e:  # noqa: BLE001  whatever is wrong with the archive, the hot rows are there
        log.error("cold search failed, hot matches only: %s", str(e)[:200])
        return found, False
    return found.unionByName(hot.sparkSession.createDataFrame(rows, old.schema)), True


def page_merged(hot: DataFrame, cold: DataFrame | None, f: SearchFilter, limit: int = 50, offset: int = 0, cap: int = SEARCH_CAP) -> DataFrame:
    limit, offset = page_bounds(limit, offset)
    rows = search_all(hot, cold, f, cap)
    return rows.orderBy(F.desc("time"), *[F.col(c) for c in sorted(rows.columns) if c != "time"]).offset(offset).limit(limit)


def list_audit(audit: DataFrame, isp: int | None = None, n: int = 100) -> DataFrame:
    """The latest lookups, of one tenant or of all (None)."""
    rows = audit if isp is None else audit.filter(F.col("isp_id") == isp)
    return rows.orderBy(F.desc("id")).limit(n)
