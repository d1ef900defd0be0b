"""The device registry: rules, policies, checks and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ingest import RULES, small

#: What a device may name.
PROTOCOL_NAMES = ["", "netflow5", "netflow9", "ipfix", "auto"]
PROFILES = ["", "mikrotik", "cisco", "juniper", "huawei", "generic"]


def resolve_policies(devices: DataFrame, policies: DataFrame) -> DataFrame:
    """Devices with the flags of their capture policy where one of that name is theirs or global; theirs first."""
    p = policies.select(F.col("isp_id").alias("p_isp"), F.col("name").alias("p_name"), F.col("id").alias("p_id"), *[F.col(r).alias(f"p_{r}") for r in RULES])
    found = devices.join(small(p), (F.col("capture_policy") == F.col("p_name")) & ((F.col("p_isp") == 0) | (F.col("p_isp") == F.col("isp_id"))), "left")
    first = F.row_number().over(Window.partitionBy("isp_id", "id").orderBy(F.desc("p_isp"), "p_id"))
    return found.withColumn("nth", first).filter("nth = 1").withColumns({r: F.when(F.col("p_id").isNotNull(), F.col(f"p_{r}")).otherwise(F.col(r)) for r in RULES}).select(*devices.columns)


def validate(devices: DataFrame) -> DataFrame:
    """(isp_id, id, problem): a row for each rule that a device breaks."""
    count = F.count("*").over(Window.partitionBy("exporter_ip"))
    rules = [
        (F.col("exporter_ip").isNull() | ~F.col("exporter_ip").between(1, 4294967295), "bad exporter address"), (F.col("same") > 1, "duplicate exporter address"),
        (F.coalesce("isp_id", F.lit(0)) <= 0, "no tenant"), (F.coalesce("device_id", F.lit(0)) <= 0, "no device number"),
        (~F.coalesce("protocol", F.lit("")).isin(PROTOCOL_NAMES), "bad protocol"), (~F.coalesce("profile", F.lit("")).isin(PROFILES), "bad profile"),
        (F.exists(F.coalesce("allowed_ports", F.array().cast("array<int>")), lambda p: ~p.between(1, 65535)), "port out of range"),
    ]
    problems = F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in rules]))
    return devices.withColumn("same", count).select("isp_id", "id", F.explode(problems).alias("problem"))


def active_exporters(devices: DataFrame, isp: int = 0) -> DataFrame:
    rows = devices.filter("enabled")
    return (rows.filter(F.col("isp_id") == isp) if isp else rows).agg(F.count("*").alias("n"))


def next_device_id(devices: DataFrame) -> DataFrame:
    """(isp_id, next_id) of every tenant."""
    return devices.groupBy("isp_id").agg((F.max("device_id") + 1).alias("next_id"))


def number_devices(new: DataFrame, devices: DataFrame) -> DataFrame:
    """New devices with the numbers after their tenant's largest, in order of their names."""
    nth = F.row_number().over(Window.partitionBy("isp_id").orderBy("name", "id"))
    return new.join(small(devices.groupBy("isp_id").agg(F.max("device_id").alias("most"))), "isp_id", "left").withColumn("device_id", (F.coalesce("most", F.lit(0)) + nth).cast("int")).drop("most")


def bundle_version(devices: DataFrame) -> DataFrame:
    """(version): 16 hex digits that change with any device. A registry is small, so one task sees it whole."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in sorted(devices.columns)]
    rows = devices.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", F.lpad(F.col("exporter_ip").cast("string"), 10, "0"), *cells))), "\n").alias("rows"))
    return rows.select(F.substring(F.sha2("rows", 256), 1, 16).alias("version"))
