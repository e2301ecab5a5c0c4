"""Connected components of a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.common import written

MAX_ROUNDS = 60                 # far above the logarithmic need; reaching it is an error


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Every round joins the neighbours of a node to the smallest of them. Rows are pairs of ids; a
    node with many neighbours is one key of an aggregate, and of a join that AQE can split.
    """
    pairs = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        # large star: larger neighbours of u are tied to the smallest neighbour
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: smaller neighbours of u, and u, are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        pairs = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = pairs.select(F.col("v").alias("node")).distinct()
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                roots.select("node", F.col("node").alias("root")))
        before = now
    raise RuntimeError("components did not settle")
