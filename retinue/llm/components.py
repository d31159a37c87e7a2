"""Connected components of links, as joins and aggregations over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retinue.llm.spread import spread_join
from retinue.session import materialise


def components(links: DataFrame) -> DataFrame:
    """``<node, label>`` for every end of the links ``<a, b>``: the smallest node reachable.

    In every round each tree of equally labelled nodes takes the smallest label
    next to any of its nodes, so whole trees merge at once. It ends when no
    label changes; there is no limit on the rounds.
    """
    ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    ends = materialise(ends.select(F.col("a").alias("node"), F.col("b").alias("other")), "links")
    n = ends.count()
    sizes = materialise(ends.groupBy("other").agg(F.count(F.lit(1)).alias("_n")), "link-counts")
    least = F.least("node", F.min("other")).alias("label")
    labels = materialise(ends.groupBy("node").agg(least), "labels")
    while True:
        seen = spread_join(ends, labels.select(F.col("node").alias("other"), "label"), "other", ["node"], total=n, sizes=sizes)
        near = seen.groupBy("node").agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("near"))
        moved = materialise(moved, "moved")
        roots = moved.groupBy("label").agg(F.min("near").alias("root"))
        joined = spread_join(moved, roots, "label", ["node"], total=n)
        labels = materialise(joined.select("node", F.col("root").alias("label"), (F.col("root") < F.col("label")).alias("changed")), "labels")
        if labels.filter("changed").isEmpty():
            return labels.select("node", "label")
