"""Totals and top lists by several keys from one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_once(df: DataFrame, keys: dict[str, Column], sums: dict[str, Column], best: dict[str, str], most: int) -> DataFrame:
    """One row whose `items` hold, for each key, its totals (place 0) and its largest groups (places 1 to most).

    Keys are whole numbers. Place 0 has the sums over all rows, those with a null key included, and in `n` how many
    different keys there are, nulls not counted. Groups go by best[key], else by `flows`, their number of rows, then by
    the smaller key; null is no group. The rows are read and shuffled once, as one partial sum for each key's group and task;
    lists are cut to `most` in each task before they meet. Runs at once: the row, of at most 1 + most items for each
    key, comes to the driver, so that whatever is made of it reads nothing again. No rows: no items.
    """
    each = F.array(*[F.struct(F.lit(name).alias("set"), k.cast("long").alias("key")) for name, k in keys.items()])
    rows = df.select(F.inline(each), *[s.alias(name) for name, s in sums.items()])
    groups = rows.groupBy("set", "key").agg(F.count("*").alias("flows"), *[F.sum(s).alias(s) for s in sums])
    sums = ["flows", *sums]
    worth = reduce(lambda c, k: c.when(F.col("set") == k, F.col(best[k])), best, F.when(F.lit(False), F.lit(0).cast("long"))).otherwise(F.col("flows"))
    # Null keys get no place, but sort last, so that both branches read the same groups and share their exchange.
    place = F.row_number().over(Window.partitionBy("set").orderBy(F.col("key").isNull(), worth.desc_nulls_last(), "key"))
    top = groups.withColumn("place", place).filter(F.col("place") <= most).select("set", "place", "key", F.lit(1).cast("long").alias("n"), *sums)
    totals = groups.groupBy("set").agg(F.count("key").alias("n"), *[F.sum(s).alias(s) for s in sums])
    both = top.unionByName(totals.withColumns({"place": F.lit(0), "key": F.lit(0).cast("long")}))
    page = both.filter("key IS NOT NULL").agg(F.collect_list(F.struct("set", "place", "key", "n", *sums)).alias("items"))
    return df.sparkSession.createDataFrame(page.collect(), page.schema)


def largest(page: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """(place, key, n, sums) of one key's groups."""
    keep = lambda x: (x["set"] == key) & (x["place"] > 0) & (F.lit(True) if most is None else x["place"] <= most)
    return page.select(F.inline(F.filter("items", keep))).drop("set")


def total(key: str, column: str) -> Column:
    """A total of one key, of a row of grouped_once(); null if there were no rows."""
    return F.get(F.filter("items", lambda x: (x["set"] == key) & (x["place"] == 0)), F.lit(0))[column]
