"""Connected components of a link table, by rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslab.session import settle


def connected_components(links: DataFrame) -> DataFrame:
    """Rows ``(node, component)`` for every node of ``links(a, b)``; component = smallest node reachable.

    Each round gives every node the smallest label among its own and its neighbours', then the
    label of that label (so chains halve). Minima are taken before the exchange, so a node with
    very many links is no hot key; rounds are written to the shared folder. Null ends and
    self-links count as no link; repeated links as one. No links: no rows.
    """
    both = links.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = settle(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                   "links")
    labels = settle(edges.groupBy(F.col("a").alias("node"))
                    .agg(F.least("a", F.min("b")).alias("component")), "labels")
    while True:
        near = (edges.join(labels, edges["b"] == labels["node"])
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        own = (labels.join(near, "node")
               .select("node", F.col("component").alias("was"),
                       F.least("component", "near").alias("low")))
        # The old label itself may have learnt of a smaller one: hook it, too.
        hooks = own.groupBy(F.col("was").alias("node")).agg(F.min("low").alias("hook"))
        low = settle(own.join(hooks, "node", "left")
                     .select("node", "was", F.least("low", "hook").alias("low")), "low")
        ends = low.select(F.col("node").alias("low"), F.col("low").alias("end"))
        after = settle(low.join(ends, "low", "left")
                       .select("node", "was", F.least("low", "end").alias("component")), "labels")
        if after.where("component <> was").limit(1).count() == 0:
            return after.select("node", "component")
        labels = after.select("node", "component")
