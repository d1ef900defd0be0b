"""Exporter health and alerts on its changes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ingest import small

EVENTS = "isp_id int, exporter_ip long, tick_s long, event string, last_s long"


def device_health(devices: DataFrame, seen: DataFrame, as_of_s: int, silence_s: int = 900) -> DataFrame:
    """(isp_id, id, exporter_ip, last_s, status, ago_s) of every device: nodata, silent or online."""
    ago = F.lit(as_of_s) - F.col("last_s")
    status = F.when(F.col("last_s").isNull(), "nodata").when(ago > silence_s, "silent").otherwise("online")
    return devices.join(small(seen), ["isp_id", "exporter_ip"], "left").select("isp_id", "id", "exporter_ip", "last_s", status.alias("status"), F.coalesce(ago, F.lit(0)).alias("ago_s"))


def fold(state: tuple[int, str, int] | None, tick_s: int, seen_s: int | None, silence_s: int, remind_s: int) -> tuple[tuple[int, str, int], str | None]:
    """((last flow, status, last alert), event) after one tick. The last flow only moves up; an exporter
    that was never seen raises nothing."""
    last, status, alerted = state or (0, "init", 0)
    last = max(last, seen_s or 0)
    if not last:
        return (last, status, alerted), None
    down = tick_s - last > silence_s
    if down and status != "silent":
        return (last, "silent", tick_s), "silent"
    if down and remind_s > 0 and tick_s - alerted >= remind_s:
        return (last, "silent", tick_s), "reminder"
    if not down:
        return (last, "healthy", alerted), "recovered" if status == "silent" else None
    return (last, status, alerted), None


def transitions(ticks: DataFrame, devices: DataFrame, silence_s: int = 900, remind_s: int = 0) -> DataFrame:
    """Alerts from ticks (isp_id, exporter_ip, tick_s, seen_s), folded in order for each enabled device.

    A device that is not in the registry or is disabled has no state. A group is one exporter's ticks.
    """
    live = devices.filter("enabled").select("isp_id", "exporter_ip").distinct()

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for tick, seen in rows.sort_values("tick_s")[["tick_s", "seen_s"]].itertuples(index=False):
            state, event = fold(state, int(tick), None if pd.isna(seen) else int(seen), silence_s, remind_s)
            if event:
                out.append((*key, int(tick), event, state[0]))
        return pd.DataFrame(out, columns=["isp_id", "exporter_ip", "tick_s", "event", "last_s"])

    return ticks.join(small(live), ["isp_id", "exporter_ip"], "left_semi").groupBy("isp_id", "exporter_ip").applyInPandas(run, EVENTS)
