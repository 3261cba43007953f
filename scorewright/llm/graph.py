"""Connected components of an edge table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b, longs), where
    root is the least node of its component.

    Large-star and small-star steps in turn until nothing changes; each round
    is written in the shared folder.  Every step is a partial aggregate and a
    join on the node, which Spark splits where a node has very many edges.  An
    edge table without rows gives none; a loop gives its node."""
    nodes = _kept(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{name}-nodes")
    now = _kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), f"{name}-0")
    seen = None
    for k in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = _kept(small.distinct(), f"{name}-{k}")
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    root = now.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(root, nodes["node"] == root["u"], "left").select("node", F.coalesce("root", "node").alias("root"))
