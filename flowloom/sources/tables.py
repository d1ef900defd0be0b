"""Tables read and written, each under its explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom import schemas
from flowloom.functions import exprs as X
from flowloom.operators.search import project_report


#: Files of a day in the hot table, at least; more where there are more than 64 shuffle partitions.
FILES_A_DAY = 8


def read_datagrams(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.DATAGRAMS).parquet(path)


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """The hot table; filters on event_date prune its partitions."""
    return spark.read.schema(schemas.FLOW_LOGS).parquet(path).drop("batch_id")


def read_day(spark: SparkSession, path: str, day: str) -> DataFrame:
    """One day of the hot table; no other day's files are listed."""
    return spark.read.schema(schemas.FLOW_LOGS).option("basePath", path).parquet(f"{path}/event_date={day}").drop("batch_id")


def read_cold(spark: SparkSession, base: str, isp: int, days: list[str] | None, fmt: str = "parquet") -> DataFrame:
    """Archived rows of the named days, or all (None), of one tenant or of all (0), with start_s and end_s parsed or null."""
    schema = f"{schemas.COLD}, isp_id int, year string, month string, day string"
    reader = spark.read.schema(schema).option("basePath", base)
    rows = reader.parquet(base) if fmt == "parquet" else reader.option("header", True).option("enforceSchema", True).csv(base)
    wanted = [d.split("-") for d in days or []]
    keep = F.lit(days is None)
    for y, m, d in wanted:
        keep = keep | ((F.col("year") == y) & (F.col("month") == m) & (F.col("day") == d))
    rows = rows.filter(keep & (F.col("isp_id") == isp if isp else F.lit(True)))
    return rows.withColumns({"start_s": X.parse_best_effort(F.col("flow_start")), "end_s": X.parse_best_effort(F.col("flow_end"))})


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The devices of a registry bundle, with its version and its mode for unknown exporters."""
    bundle = spark.read.schema(schemas.REGISTRY_BUNDLE).option("multiLine", True).json(path)
    return bundle.select("version", "unknown_mode", F.explode("devices").alias("d")).select("version", "unknown_mode", "d.*")


def found(spark: SparkSession, pattern: str) -> list[str]:
    """The files and folders of a pattern."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [x.getPath().toString() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []]


def delete(spark: SparkSession, pattern: str) -> int:
    """Deletes the files and folders of a pattern; how many there were."""
    names = found(spark, pattern)
    for x in names:
        at = spark._jvm.org.apache.hadoop.fs.Path(x)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(names)


def write_flows(df: DataFrame, path: str, files: int | None = None, batch_id: int = -1) -> None:
    """Appends flow_logs by day, and below it by micro-batch (-1: none); rows of one exporter and device stand together, in
    the order of the table's key, so that Parquet's statistics and Bloom filters on addresses find them. A micro-batch
    overwrites what it has written before. A day has at most `files` files, and a task sorts single files of single days, so it
    holds the less the more days and files there are."""
    if batch_id >= 0:
        delete(df.sparkSession, f"{path}/event_date=*/batch_id={batch_id}")  # of days, too, that it has no rows for this time
    files = files or max(FILES_A_DAY, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    rows = df.repartition("event_date", F.pmod(F.xxhash64("exporter_ip", "device_id"), F.lit(files))).sortWithinPartitions("event_date", *schemas.FLOW_KEY)
    out = rows.withColumn("batch_id", F.lit(batch_id)).write.partitionBy("event_date", "batch_id")
    out = out.mode("append") if batch_id < 0 else out.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out = out.option("parquet.bloom.filter.adaptive.enabled", "true")  # else each takes its most, 1 MB, in however small a file
    for c in ("nat_public_ip", "src_ip"):
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(path)


def write_report_csv(records: DataFrame, meta: dict[str, str], path: str) -> None:
    """A disclosure report: eight columns, spreadsheet-safe, in one file, and its head beside it."""
    spark = records.sparkSession
    project_report(records).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    head = spark.createDataFrame(list(meta.items()), "name string, value string").withColumn("value", X.formula_safe(F.col("value")))
    head.coalesce(1).write.mode("overwrite").csv(f"{path}/head")


def append_audit(spark: SparkSession, path: str, entry: dict) -> None:
    """One lookup record, appended."""
    spark.createDataFrame([entry], schemas.QUERY_AUDIT).write.mode("append").parquet(path)
