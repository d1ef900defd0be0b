"""Retention and the archive: what expires, what is written where, and the books about it."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.functions import exprs as X

COLD_COLUMNS = ["device_id", "src_ip", "src_port", "dst_ip", "dst_port", "nat_public_ip", "nat_public_port", "protocol", "bytes", "packets", "flow_start", "flow_end", "flow_type", "exporter_ip"]
#: Days that flows are kept, and that the archive waits.
TTL_DAYS, ARCHIVE_AFTER = 180, 7
ROWS_PER_FILE = 2_000_000
#: Days of a sweep whose jobs run side by side: those of one day leave most of a cluster idle.
DAYS_AT_ONCE = 4


def ttl_days(days: int = TTL_DAYS, archive_after: int | None = None) -> int:
    """Days that are kept: at least one, and two more than the archive waits where it runs by itself."""
    return max(days, 1, archive_after + 2 if archive_after is not None else 1)


def expire_days(df: DataFrame, days: int, as_of: str, archive_after: int | None = None) -> DataFrame:
    """Rows whose day plus the time to live isn't past yet."""
    return df.filter(F.date_add("event_date", ttl_days(days, archive_after)) > F.lit(as_of).cast("date"))


def project_archive(df: DataFrame, *more: str) -> DataFrame:
    """The 15 columns with the tenant, addresses as dotted text and times in UTC, and the day."""
    text = {c: X.inet_ntoa(F.col(c)) for c in ("src_ip", "dst_ip", "nat_public_ip", "exporter_ip")}
    clock = lambda c: X.ist_text(X.epoch(F.col(c)) - X.IST)
    return df.withColumns(text | {c: clock(c) for c in ("flow_start", "flow_end")}).select("isp_id", "event_date", *COLD_COLUMNS, *more)


def file_numbers(df: DataFrame, rows_per_file: int) -> DataFrame:
    """df with `file`: a number within each tenant and day, so that files hold stretches of about rows_per_file rows by device and time.

    Rows are counted by tenant, device and quarter of an hour; those counts alone are ordered and summed up. A cell with more
    rows than a file is dealt to as many files as it needs.
    """
    cell = ["isp_id", "event_date", "device_id", "__quarter"]
    rows = df.withColumn("__quarter", F.floor(X.epoch(F.col("flow_start")) / 900))
    order = Window.partitionBy("isp_id", "event_date").orderBy("device_id", "__quarter").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*cell).agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__first", F.floor(F.coalesce(F.sum("__n").over(order), F.lit(0)) / rows_per_file)).withColumn("__parts", F.greatest(F.lit(1), F.ceil(F.col("__n") / rows_per_file)))
    counts = counts.select(*[F.col(c).alias(f"__of{i}") for i, c in enumerate(cell)], "__first", "__parts")
    joined = rows.join(counts, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of{i}")) for i, c in enumerate(cell)]))
    dealt = F.pmod(F.xxhash64(*df.columns), F.col("__parts"))
    return joined.withColumn("file", F.when(F.col("__parts") > 1, F.col("__first") + dealt).otherwise(F.col("__first"))).select(*df.columns, "file")


def write_archive(df: DataFrame, base: str, fmt: str = "parquet", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Writes flows below base/isp_id=/year=/month=/day=, as Parquet or gzip CSV: large days of a tenant as files of about
    rows_per_file rows, by device and time. The partitions that it has rows of are overwritten, and no others."""
    d = F.col("event_date")
    rows = project_archive(file_numbers(df, rows_per_file), "file").withColumns({"year": F.date_format(d, "yyyy"), "month": F.date_format(d, "MM"), "day": F.date_format(d, "dd")})
    spread = rows.repartition("isp_id", "event_date", "file").drop("file", "event_date")
    out = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 2 * rows_per_file).partitionBy("isp_id", "year", "month", "day")
    out.parquet(base) if fmt == "parquet" else out.option("header", True).option("compression", "gzip").csv(base)


def archive_day(df: DataFrame, day: str, base: str, fmt: str = "parquet", rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """write_archive() of one day; returns what then stands there, as summed_up() of the files read back. A tenant without rows
    that day gets no directory."""
    write_archive(df.filter(F.col("event_date") == F.lit(day).cast("date")), base, fmt, rows_per_file)
    return written_day(df.sparkSession, base, day, fmt)


def summed_up(archive: DataFrame) -> DataFrame:
    """(isp_id, rows, sum_of_hashes, xor_of_hashes) of archive rows, for telling whether two hold the same."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in COLD_COLUMNS])
    return archive.groupBy("isp_id").agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("sum_of_hashes"), F.bit_xor(h).alias("xor_of_hashes"))


def written_day(spark: SparkSession, base: str, day: str, fmt: str = "parquet") -> DataFrame:
    from flowloom.sources.tables import read_cold

    return summed_up(read_cold(spark, base, 0, [day], fmt))


def handed_over(hot: DataFrame, day: str, written: DataFrame) -> bool:
    """Whether the archive, as read back, holds each tenant's rows of the day, and nothing else."""
    wanted = summed_up(project_archive(hot.filter(F.col("event_date") == F.lit(day).cast("date"))))
    columns = wanted.columns
    both = wanted.withColumn("side", F.lit(1)).unionByName(written.select(*columns).withColumn("side", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("side").alias("side")).filter("side <> 0").isEmpty()


def archive_candidates(df: DataFrame, archived: DataFrame, after: int, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(days to export, days that are archived already and only to be dropped) among days past the window."""
    old = df.filter(F.col("event_date") < F.date_sub(F.lit(as_of).cast("date"), after)).select(F.col("event_date").alias("day")).distinct()
    return old.join(archived, "day", "left_anti"), old.join(archived, "day", "left_semi")


def archive_plan(df: DataFrame, archived: DataFrame, after: int, as_of: str) -> DataFrame:
    """(day, isp_id, rows, action) of every day past the window and every tenant that has rows in it."""
    old = df.filter(F.col("event_date") < F.date_sub(F.lit(as_of).cast("date"), after)).groupBy(F.col("event_date").alias("day"), "isp_id").agg(F.count("*").alias("rows"))
    known = archived.select("day", F.lit(True).alias("known")).distinct()
    return old.join(known, "day", "left").select("day", "isp_id", "rows", F.when(F.col("known"), "drop").otherwise("export").alias("action"))


def upsert_archived_days(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per day: the new one where there is one."""
    both = old.withColumn("nth", F.lit(0)).unionByName(new.withColumn("nth", F.lit(1)))
    last = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("nth"), F.desc("archived_at")))
    return both.withColumn("last", last).filter("last = 1").select(*old.columns)


def list_archived_days(days: DataFrame, n: int = 30) -> DataFrame:
    return days.orderBy(F.desc("day")).limit(n)


def drop_day(spark: SparkSession, path: str, day: str) -> bool:
    """Deletes one day's partition of a hot table; says whether there was one. The day must be a date."""
    valid = spark.sql("SELECT date_format(try_cast(:d AS DATE), 'yyyy-MM-dd') = :d AS ok", {"d": day}).first()["ok"]
    if not valid:
        raise ValueError(f"not a day: {day}")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/event_date={day}")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def archive_one_day(df: DataFrame, day: str, base: str, fmt: str = "parquet") -> DataFrame:
    """(isp_id, rows, status) of an archive run on demand; a failure is a row, not an error."""
    try:
        return archive_day(df, day, base, fmt).withColumn("status", F.lit("archived"))
    except Exception as e:  # noqa: BLE001  any failed write leaves the hot day as it is
        return df.sparkSession.createDataFrame([(0, 0, f"failed: {str(e)[:200]}")], "isp_id int, rows long, status string")


def archive_sweep(spark: SparkSession, hot_path: str, archived: DataFrame, base: str, after: int = ARCHIVE_AFTER, as_of: str = "1970-01-01", fmt: str = "parquet", save=None) -> DataFrame:
    """One status row per day past the window: archived before (dropped again), exported and dropped, or left.

    A day is dropped only when its archive, read back, has each tenant's rows by number and digest, and the books
    are saved, by `save` on a DataFrame of the new row. No rows, a failed export, files that lack something or
    failed books leave the day. Days are exported side by side, each from its own partition by jobs of its own, and
    booked and dropped one after the other.
    """
    from flowloom.sources.tables import read_day

    def exported(day: str) -> tuple[DataFrame, int, bool]:
        hot = read_day(spark, hot_path, day)
        status = archive_one_day(hot, day, base, fmt).persist()
        n = status.agg(F.sum("rows"), F.max("status")).first()
        return status, n[0] or 0, bool(n[0]) and n[1] == "archived" and handed_over(hot, day, status)

    hot = spark.read.parquet(hot_path)
    export, again = archive_candidates(hot, archived, after, as_of)
    export, again = export.orderBy("day").collect(), again.orderBy("day").collect()  # days, not rows
    out = []
    for r in again:
        drop_day(spark, hot_path, str(r["day"]))
        out.append((r["day"], 0, "already archived, dropped"))
    with ThreadPoolExecutor(DAYS_AT_ONCE) as pool:
        results = pool.map(exported, [str(r["day"]) for r in export])
        for r, (status, n, whole) in zip(export, results):
            try:
                if whole and save:
                    save(spark.createDataFrame([(r["day"], status.count(), n)], "day date, objects int, rows long"))
            except Exception:  # noqa: BLE001  without books the day stays hot
                whole = False
            status.unpersist()
            if whole:
                drop_day(spark, hot_path, str(r["day"]))
            out.append((r["day"], n, "archived, dropped" if whole else "left"))
    return spark.createDataFrame(out, "day date, rows long, status string")
