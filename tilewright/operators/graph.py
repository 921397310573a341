"""Connected components of links, as DataFrame loops over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import frozen


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, group): the least node each node of ``links`` is connected with.

    Every round gives each node the least label of itself and its neighbours, then
    the label's own label, so that long chains take few rounds.
    """
    edges = frozen(links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(b, a)).distinct(), "graph-edges")
    now = frozen(edges.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("group")), "graph-labels")
    while True:
        near = edges.join(now.select(F.col("node").alias("other"), F.col("group").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        hop = now.select(F.col("node").alias("group"), F.col("group").alias("far"))
        step = now.join(near, "node").join(hop, "group").select("node", F.least("group", "near", "far").alias("group"), (F.least("group", "near", "far") != F.col("group")).alias("moved"))
        step = frozen(step, "graph-labels")
        if step.where("moved").isEmpty():
            return now
        now = step.select("node", "group")
