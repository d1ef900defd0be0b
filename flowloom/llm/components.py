"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, work: str = "") -> DataFrame:
    """(id, component) of every node of the edges (a, b): the smallest id that is reachable.

    Each round takes the smallest label among neighbours and then the label of that label, so rounds
    grow with the logarithm of the longest chain. Joins keep all rows of a node apart from its label,
    which is unique, so a node with very many links is dealt to several tasks. Labels are written to the
    shared folder in each round, their names after `work`. No edges: no rows. Edges with a null end are left out.
    """
    edges = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{work}edges")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "id"), f"{work}labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("least"))
        better = labels.join(near, labels.id == near.a, "left").select("id", F.col("component").alias("before"), F.least("component", "least").alias("component"))
        at = labels.select(F.col("id").alias("at"), F.col("component").alias("there"))
        new = written(better.join(at, better.component == at["at"], "left").select("id", "before", F.least("component", "there").alias("component")), f"{work}labels")
        if new.filter("before <> component").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
