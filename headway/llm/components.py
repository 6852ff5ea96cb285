"""Connected components of a link table by contraction, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links; component is the smallest node reachable.

    Each round every node points to its smallest neighbour or itself, and the links are redrawn
    between the nodes pointed to; nodes only get smaller, so the smallest node of a component is
    its last name. Rounds are written to the shared folder. Nulls and self links are ignored.
    The minimum is a partial aggregation, so a hub with many links is no hot spot.
    """
    both = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = saved(both.union(both.select("v", "u")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        step = saved(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "step")
        if labels is None:
            labels = step.select(F.col("u").alias("node"), F.col("m").alias("component"))
        else:
            labels = labels.join(step, labels.component == step.u, "left").select("node", F.coalesce("m", "component").alias("component"))
        labels = saved(labels, "labels")
        to_u, to_v = step.select("u", F.col("m").alias("mu")), step.select(F.col("u").alias("v"), F.col("m").alias("mv"))
        edges = saved(edges.join(to_u, "u").join(to_v, "v").where("mu != mv").select(F.col("mu").alias("u"), F.col("mv").alias("v")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
