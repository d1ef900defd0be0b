"""The streaming forms: ingest, template state, rollups and liveness."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from flowloom.operators import decode as D
from flowloom.operators import ingest as I
from flowloom.operators import liveness as V
from flowloom.operators import rollup as R
from flowloom.operators import templates as Life
from flowloom.sources import tables as T

TTL_MS = 30 * 60 * 1000
ACCOUNTED = "state string, reason string, flows long, bytes long"
STATEFUL = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def ingest_stream(datagrams: DataFrame, registry: Callable[[SparkSession], DataFrame], path: str, checkpoint: str, mode: str = "allow", ttl_s: int = TTL_MS // 1000, **trigger) -> StreamingQuery:
    """Datagrams to the hot table: decoded, stamped, guarded, filtered and appended by day.

    The registry is read anew for every micro-batch; if that fails, the one before stays in force.
    Templates are kept over micro-batches, for ttl_s seconds after they were last sent or used, in a table beside the
    checkpoint: each micro-batch reads the one of the batch before and writes its own, and the one before that goes. However the
    same datagrams are cut into batches, the same flows are stored. A micro-batch that runs again
    overwrites its own flows and templates, so each flow is stored once. Flows of one day stand in that day's
    partition, below it by micro-batch; read_flows() reads them, and drop_day() drops them. What became of every flow is
    counted while a batch is written and kept beside the checkpoint by micro-batch, for read_accounting().
    """
    held: list[DataFrame] = []
    templates = f"{checkpoint}-templates"

    def store(batch: DataFrame, batch_id: int) -> None:
        try:
            held[:] = [registry(batch.sparkSession)]
        except Exception:  # noqa: BLE001  a registry that can't be read leaves the last one in force
            if not held:
                raise
        spark, events = batch.sparkSession, D.events_of(batch)
        if batch_id:
            events = spark.read.schema(Life.EVENTS).parquet(f"{templates}/{batch_id - 1}").unionByName(events)
        chain = Life.chained(events, ttl_s).persist()
        try:
            now = chain.agg(F.max("latest")).first()[0]
            Life.carried(chain, ttl_s, now).write.mode("overwrite").parquet(f"{templates}/{batch_id}")
            raw, watch = D.to_raw_flows(D.decode(batch, ttl_s, chain=chain)), Observation()
            T.write_flows(I.ingest(raw, held[0], mode, watch), path, batch_id=batch_id)
            spark.createDataFrame(became(watch, raw, held[0], mode), ACCOUNTED).coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}-accounting/batch_id={batch_id}")
        finally:
            chain.unpersist()
        T.delete(spark, f"{templates}/{batch_id - 2}")

    return datagrams.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def became(watch: Observation, raw: DataFrame, devices: DataFrame, mode: str) -> list[tuple]:
    """Rows of accounting() of a batch that is written. Where nothing was left to write, the adaptive plan shrinks to an empty one
    and its numbers are lost with it, so they are taken anew."""
    try:
        return I.outcomes(watch.get)
    except Py4JJavaError:
        return [tuple(r) for r in I.accounting(raw, devices, mode).select("state", "reason", "flows", "bytes").collect()]


def read_accounting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(state, reason, flows, bytes) of all that an ingest stream has stored or left out: accounting() of its input."""
    return spark.read.schema(f"{ACCOUNTED}, batch_id long").parquet(f"{checkpoint}-accounting").groupBy("state", "reason").agg(F.sum("flows").alias("flows"), F.sum("bytes").alias("bytes"))


TEMPLATE_EVENTS = StructType([StructField("exporter_ip", LongType()), StructField("domain", LongType()), StructField("version", IntegerType()), StructField("template_id", IntegerType()), StructField("event", StringType()), StructField("template", StringType())])


class Templates(StatefulProcessor):
    """Templates of one exporter and domain as JSON by version and id, each with when it was last sent or used. Idle ones expire by
    the times of the datagrams, however late they are read; beyond `most` the one unused longest goes."""

    def __init__(self, ttl_s: int, most: int):
        self.ttl_us, self.most = ttl_s * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("templates", "id string", "template string, used long")
        self.held = handle.getValueState("held", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        out, held = [], int(self.held.get()[0]) if self.held.exists() else 0

        def tell(r: dict, event: str, template: str | None = None) -> None:
            out.append((*key, r["version"], r["template_id"], event, template))

        for r in sorted((r for part in rows for r in part.to_dict("records")), key=lambda r: (r["recv_ts"], r["datagram_id"], r["set_ordinal"], r["template_ordinal"])):
            name, now, told = (f"{r['version']}/{r['template_id']}",), r["recv_ts"].value // 1000, r["definition"]
            found = self.known.getValue(name) if self.known.containsKey(name) else None
            if found is not None and (told == Life.WITHDRAWN or now - found[1] > self.ttl_us):
                self.known.removeKey(name)
                held, found = held - 1, None
            if told is None:  # a data set asks
                if found is not None:
                    self.known.updateValue(name, (found[0], max(found[1], now)))
                tell(r, "known" if found else "unknown", found[0] if found else None)
            elif told == Life.WITHDRAWN:
                tell(r, "withdrawn")
            else:
                self.known.updateValue(name, (told, now))
                held += found is None
                tell(r, "stored", told)
                if held > self.most:
                    oldest = min(self.known.iterator(), key=lambda kv: (kv[1][1], kv[0]))[0]
                    self.known.removeKey(oldest)
                    held -= 1
                    v, t = oldest[0].split("/")
                    tell({"version": int(v), "template_id": int(t)}, "evicted")
        self.held.update((held,))
        yield pd.DataFrame(out, columns=[f.name for f in TEMPLATE_EVENTS])

    def close(self) -> None:
        pass


def template_state(datagrams: DataFrame, ttl_s: int = TTL_MS // 1000, most: int = Life.MOST_TEMPLATES) -> DataFrame:
    """What each exporter's templates do: stored, withdrawn, evicted, and known or unknown where a data set asks; set STATEFUL on
    the session. For watching exporters: ingest_stream() doesn't send payloads through state."""
    return D.events_of(datagrams).drop("used").groupBy("exporter_ip", "domain").transformWithStateInPandas(Templates(ttl_s, most), TEMPLATE_EVENTS, "Append", "None")


def rollup_stream(flows: DataFrame, path: str, checkpoint: str, compact_every: int = 720, **trigger) -> StreamingQuery:
    """Both rollups of every micro-batch, each in a directory of its batch that a repeated run overwrites; read them with
    read_rollup(). Every so many batches the older ones are merged."""

    def store(batch: DataFrame, batch_id: int) -> None:
        R.rollup_hourly(batch).write.mode("overwrite").parquet(f"{path}/hourly/batch_id={batch_id}")
        R.rollup_subs(batch).write.mode("overwrite").parquet(f"{path}/subs/batch_id={batch_id}")
        if batch_id % compact_every == compact_every - 1:
            compact_rollup(batch.sparkSession, path, batch_id - 1)

    return flows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "2 minutes"})).start()


def generations(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(number, last batch merged into it) of the finished generations, in order."""
    done = T.found(spark, f"{path}/generations/*/through/_SUCCESS")
    numbers = sorted(int(x.split("/")[-3]) for x in done)
    return [(g, spark.read.schema("through long").json(f"{path}/generations/{g}/through").first()[0]) for g in numbers[-2:]]


def parts_of(spark: SparkSession, path: str, kind: str, generation: tuple[int, int] | None, last: int | None = None) -> DataFrame:
    """The rows of a generation and of the batches after it, up to `last`."""
    batches = spark.read.parquet(f"{path}/{kind}")
    rows = batches.filter((F.col("batch_id") > (generation[1] if generation else -1)) & (F.lit(True) if last is None else F.col("batch_id") <= last)).drop("batch_id")
    return rows.unionByName(spark.read.parquet(f"{path}/generations/{generation[0]}/{kind}")) if generation else rows


def compact_rollup(spark: SparkSession, path: str, last: int) -> None:
    """Merges the last generation and the batches after it, up to `last`, into a new generation.

    A generation counts once its `through` is written, whole; from then on readers take it instead of its batches. What it
    replaces stays until the next compaction, so readers that have begun find their files. A batch at or below
    `through` that runs again writes where nobody reads. One that breaks off leaves no trace that is read.
    """
    before = generations(spark, path)
    newest = before[-1] if before else None
    if newest and last <= newest[1]:
        return
    g = newest[0] + 1 if newest else 0
    for kind, merge in (("hourly", R.merge_rollup), ("subs", R.merge_subs)):
        merge(parts_of(spark, path, kind, newest, last)).write.mode("overwrite").parquet(f"{path}/generations/{g}/{kind}")
    spark.createDataFrame([(last,)], "through long").coalesce(1).write.mode("overwrite").json(f"{path}/generations/{g}/through")
    if newest:  # what nobody has been sent to since the compaction before
        for kind in ("hourly", "subs"):
            for x in T.found(spark, f"{path}/{kind}/batch_id=*"):
                if int(x.rpartition("=")[2]) <= newest[1]:
                    T.delete(spark, x)
        T.delete(spark, f"{path}/generations/{newest[0] - 1}")


def read_rollup(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(hourly, subscriber days): the newest generation and the batches after it, merged."""
    newest = (generations(spark, path) or [None])[-1]
    return R.merge_rollup(parts_of(spark, path, "hourly", newest)), R.merge_subs(parts_of(spark, path, "subs", newest))


LIVENESS_EVENTS = StructType([StructField("isp_id", IntegerType()), StructField("exporter_ip", LongType()), StructField("tick_s", LongType()), StructField("event", StringType()), StructField("last_s", LongType())])


class Liveness(StatefulProcessor):
    """The fold of liveness.transitions() over ticks as they come; a tick of an exporter that isn't enabled forgets it."""

    def __init__(self, silence_s: int, remind_s: int):
        self.silence_s, self.remind_s = silence_s, remind_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "last long, status string, alerted long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        state, out = tuple(self.state.get()) if self.state.exists() else None, []
        ticks = [(int(r["tick_s"]), None if pd.isna(r["seen_s"]) else int(r["seen_s"]), bool(r["known"])) for part in rows for r in part.to_dict("records")]
        for tick, seen, known in sorted(ticks, key=lambda t: (t[0], t[1] or 0)):
            if not known:
                state = None
                continue
            state, event = V.fold(state, tick, seen, self.silence_s, self.remind_s)
            if event:
                out.append((*key, tick, event, state[0]))
        if state:
            self.state.update(state)
        else:
            self.state.clear()
        yield pd.DataFrame(out, columns=[f.name for f in LIVENESS_EVENTS])

    def close(self) -> None:
        pass


def liveness_stream(ticks: DataFrame, devices: DataFrame, silence_s: int = 900, remind_s: int = 0) -> DataFrame:
    """Alerts as ticks arrive; devices are read anew with each micro-batch by the stream-static join.

    An exporter that is taken out of the registry, or disabled, is forgotten with its next tick: when it comes back it starts
    anew, without a recovery of what was before.
    """
    live = devices.filter("enabled").select("isp_id", "exporter_ip", F.lit(True).alias("known")).distinct()
    known = ticks.join(live, ["isp_id", "exporter_ip"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return known.groupBy("isp_id", "exporter_ip").transformWithStateInPandas(Liveness(silence_s, remind_s), LIVENESS_EVENTS, "Append", "None")


class Silence(StatefulProcessor):
    """Alerts by timers of the cluster's clock; see silence_stream()."""

    def __init__(self, silence_s: int, remind_s: int, lease_s: int):
        self.silence_s, self.remind_s, self.lease_s = silence_s, remind_s, lease_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last long, status string, alerted long, listed long")

    def step(self, key, state: tuple, now_s: int, seen_s: int | None) -> Iterator[pd.DataFrame]:
        """Keeps the state after one look at the clock, its next timer set, and tells what happened."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        last, status, alerted, listed = state
        if listed + self.lease_s < now_s:  # neither listed of late, nor ever
            self.state.clear()
            return
        folded, event = V.fold((last, status, alerted), now_s, seen_s, self.silence_s, self.remind_s)
        self.state.update((*folded, listed))
        last, status, alerted = folded
        # A second after each bound: silence is more than silence_s, and a lease ends when it is over.
        due = [listed + self.lease_s + 1]
        if last and status != "silent":
            due.append(last + self.silence_s + 1)
        if status == "silent" and self.remind_s > 0:
            due.append(alerted + self.remind_s)
        self.handle.registerTimer(max(min(due), now_s + 1) * 1000)
        if event:
            yield pd.DataFrame([(*key, now_s, event, last)], columns=[f.name for f in LIVENESS_EVENTS])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        now, table = timers.getCurrentProcessingTimeInMs() // 1000, pd.concat(list(rows))
        last, status, alerted, listed = tuple(self.state.get()) if self.state.exists() else (0, "init", 0, 0)
        newest = table[table["listed_s"].notna()].sort_values(["listed_s", "enabled"])
        if len(newest) and newest["listed_s"].iloc[-1] >= listed:
            listed = int(newest["listed_s"].iloc[-1]) if newest["enabled"].iloc[-1] else 0
        seen = table["seen_s"].max()
        yield from self.step(key, (last, status, alerted, listed), now, None if pd.isna(seen) else int(seen))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            yield from self.step(key, tuple(self.state.get()), timerValues.getCurrentProcessingTimeInMs() // 1000, None)

    def close(self) -> None:
        pass


def silence_stream(seen: DataFrame, listed: DataFrame, silence_s: int = 900, remind_s: int = 0, lease_s: int = 3600) -> DataFrame:
    """Alerts without ticks: silence and reminders are raised by processing-time timers, one pending for each exporter.

    seen: (isp_id, exporter_ip, seen_s), one row or more an exporter and batch. listed: (isp_id, exporter_ip, enabled,
    listed_s), every device each time the registry is read. An exporter is watched for lease_s seconds after a registry
    listed it last; then, or at once when it is listed as disabled, its state goes, silently. An exporter that is in no
    registry, or was seen before one listed it, has no state. Set STATEFUL on the session. tick_s is when it was noticed.
    """
    rows = seen.select("isp_id", "exporter_ip", F.col("seen_s").cast("long").alias("seen_s"), F.lit(None).cast("boolean").alias("enabled"), F.lit(None).cast("long").alias("listed_s"))
    rows = rows.unionByName(listed.select("isp_id", "exporter_ip", F.lit(None).cast("long").alias("seen_s"), "enabled", F.col("listed_s").cast("long").alias("listed_s")))
    return rows.groupBy("isp_id", "exporter_ip").transformWithStateInPandas(Silence(silence_s, remind_s, lease_s), LIVENESS_EVENTS, "Append", "ProcessingTime")
