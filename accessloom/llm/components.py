"""Connected components of an edge table, in DataFrame rounds; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that it reaches) of every node of edges (u, v: long).

    Each round a node and its present root take the smallest label across their edges (combined before the shuffle, so a
    node of any degree is no burden), then labels skip to the label's label. Rounds go on until no label moves.
    """
    both = cut(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct().toDF("u", "v"))
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("root")))
    while True:
        mine, other = labels.toDF("u", "own"), labels.toDF("v", "its")
        seen = both.join(mine, "u").join(other, "v").where("its < own")
        offers = seen.select(F.col("u").alias("node"), "its").union(seen.select("own", "its"))
        best = offers.groupBy("node").agg(F.min("its").alias("its"))
        moved = labels.join(best, "node", "left").select("node", F.col("root").alias("was"), F.least("root", "its").alias("next"))
        jump = moved.select(F.col("node").alias("next"), F.col("next").alias("then"))
        labels = cut(moved.join(jump, "next").select("node", F.col("then").alias("root"), (F.col("then") < F.col("was")).alias("moved")))
        if labels.where("moved").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
