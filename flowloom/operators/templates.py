"""The life of export templates: which definition holds for which data set.

A template holds for its exporter, version, domain and id from its arrival until it is sent anew, withdrawn, or neither
sent nor used for the time to live; every use keeps it alive. So its life is a chain of sets with no gap beyond the time to live.
It is found in two levels. Within a key and a minute no gap can be too long, so all that counts of a minute are its first and
last set and the places where the definition changes; that level has most of the rows of hot exporters and is spread by minute.
Then the minutes of a key are chained, which are few rows whatever the exporter sends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["exporter_ip", "version", "domain", "template_id"]
#: The order in which sets and templates arrive.
ARRIVAL = ["recv_ts", "datagram_id", "set_ordinal", "template_ordinal"]
#: `definition` is JSON, null for a data set that asks; `used` is when a template from before was last used.
EVENTS = "exporter_ip long, version int, domain long, template_id int, recv_ts timestamp, datagram_id long, set_ordinal int, template_ordinal int, definition string, used timestamp"
WITHDRAWN = "withdrawn"
#: Of what is kept between batches: templates of all exporters, the longest unused ones going first.
MOST_TEMPLATES = 1 << 16
SLICE_S = 60


def slice_of(ttl_s: int | None):
    return F.floor(F.unix_seconds("recv_ts") / max(1, min(SLICE_S, ttl_s or SLICE_S)))


def chained(events: DataFrame, ttl_s: int | None = None) -> DataFrame:
    """(KEY, slice, ARRIVAL, latest, state) of the first and the last event of every key and minute and of each change of the definition
    within it. `state` is the definition in force from there on: null before the first one, `withdrawn` after a withdrawal
    or where a data set asks after a gap beyond ttl_s (None: no limit); `latest` the last use so far in the minute."""
    rows = events.withColumns({"slice": slice_of(ttl_s), "at": F.unix_micros(F.coalesce("used", "recv_ts"))})
    minute = Window.partitionBy(*KEY, "slice")
    within = minute.orderBy(*ARRIVAL)
    before = F.last("definition", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumns({
        "changed": F.coalesce(F.col("definition").isNotNull() & ~F.col("definition").eqNullSafe(before), F.lit(False)), "first": F.row_number().over(within) == 1,
        "ends": F.lead("recv_ts").over(within).isNull(), "latest": F.max("at").over(minute),
    })
    few = marked.filter("changed OR first OR ends")
    chain = Window.partitionBy(*KEY).orderBy(*ARRIVAL)
    gone = F.lit(False) if ttl_s is None else F.col("first") & F.col("definition").isNull() & (F.col("at") - F.lag("latest").over(chain) > ttl_s * 1_000_000)
    told = few.withColumn("told", F.when(F.col("changed"), F.col("definition")).when(gone, WITHDRAWN))
    state = F.last("told", ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, 0))
    return told.select(*KEY, "slice", *ARRIVAL, "latest", state.alias("state"))


def changes(chain: DataFrame) -> DataFrame:
    """(KEY, ARRIVAL, state) of the places where what holds for a key changes."""
    before = F.lag("state").over(Window.partitionBy(*KEY).orderBy(*ARRIVAL))
    return chain.withColumn("before", before).filter("state IS NOT NULL AND (before IS NULL OR before <> state)").select(*KEY, *ARRIVAL, "state")


def carried(chain: DataFrame, ttl_s: int | None = None, now_us: int | None = None, most: int = MOST_TEMPLATES) -> DataFrame:
    """What later batches have to know, as EVENTS: the definitions in force, with when they were last used. Idle ones are left
    out, counted from now_us, and beyond `most` those used longest ago."""
    last = chain.groupBy(*KEY).agg(F.max_by("state", F.struct(*ARRIVAL)).alias("definition"), F.max("latest").alias("at")).filter(F.col("definition") != WITHDRAWN)
    if ttl_s is not None and now_us is not None:
        last = last.filter(F.lit(now_us) - F.col("at") <= ttl_s * 1_000_000)
    last = last.orderBy(F.desc("at"), *KEY).limit(most)
    return last.select(*KEY, F.timestamp_seconds(F.lit(0)).alias("recv_ts"), F.lit(0).cast("long").alias("datagram_id"), F.lit(0).alias("set_ordinal"), F.lit(0).alias("template_ordinal"), "definition", F.timestamp_micros("at").alias("used"))


def in_force(asks: DataFrame, chain: DataFrame, ttl_s: int | None = None) -> DataFrame:
    """asks (KEY, ARRIVAL, ...) with `definition`, null where none is in force: an as-of join within each key and minute."""
    rows = asks.withColumns({"slice": slice_of(ttl_s), "asks": F.lit(True), "state": F.lit(None).cast("string")})
    both = rows.unionByName(chain.select(*KEY, "slice", *ARRIVAL, F.lit(False).alias("asks"), "state"), allowMissingColumns=True)
    before = Window.partitionBy(*KEY, "slice").orderBy(*ARRIVAL, "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("state", F.last("state", ignorenulls=True).over(before)).filter("asks")
    return found.withColumn("definition", F.when(F.col("state") != WITHDRAWN, F.col("state"))).select(*asks.columns, "definition")
