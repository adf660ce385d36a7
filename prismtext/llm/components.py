"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of ``links``.

    Alternates the two star operations: each node tells its larger neighbours,
    then its smaller ones, of the smallest node it knows. Every round is one
    aggregation over the links; the number of rounds grows with the logarithm
    of the longest path. Nothing but one counter passes the driver.
    """
    edges = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where(F.col("u") != F.col("v")).distinct()
    edges = materialize(edges, "edges")
    nodes = edges.select(F.col("v").alias("node")).union(edges.select(F.col("u").alias("node"))).distinct()
    signature = F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))
    sign = edges.agg(*signature).first()
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        # Larger neighbours hang on to the smallest known node.
        large = both.join(least, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u")).where(F.col("u") != F.col("v")).distinct()
        large = materialize(large, "large")
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        linked = large.join(small, "v")
        new = linked.select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u")).distinct()
        new = materialize(new.where(F.col("u") != F.col("v")), "small")
        edges, was, sign = new, sign, new.agg(*signature).first()
        if was == sign:
            break
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    found = edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
