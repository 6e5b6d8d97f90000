"""Taxonomy trees: depths and lowest common ancestors by joins with the closure of ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored


def taxid_label(name: Column | str) -> Column:
    """The taxid of a header with ``kraken:taxid|n`` , else the accession of ``gi|..|..|accession``, else its first word."""
    c = F.col(name) if isinstance(name, str) else name
    kraken, gi = F.regexp_extract(c, r"kraken:taxid\|(\d+)", 1), F.regexp_extract(c, r"^gi\|[^|]*\|[^|]*\|([^| ]+)", 1)
    return F.when(kraken != "", kraken).when(gi != "", gi).otherwise(F.regexp_extract(c, r"^(\S*)", 1))


def ancestors(tree: DataFrame) -> DataFrame:
    """node, ancestor, up: each node with itself (0), its parent (1) and so on; the root is its own parent.

    Paths double in a round, so rounds are as many as the logarithm of the depth.
    """
    up = stored(tree.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("up")).where("node <> ancestor"), "tree")
    every = stored(tree.select(F.col("child").alias("node"), F.col("child").alias("ancestor"), F.lit(0).alias("up")).unionByName(tree.select(F.col("parent").alias("node"), F.col("parent").alias("ancestor"), F.lit(0).alias("up"))).distinct().unionByName(up), "closure")
    far, step = up, 1
    while not far.isEmpty():
        a = every.select("node", F.col("ancestor").alias("m"), F.col("up").alias("u1"))
        b = far.where(F.col("up") == step).select(F.col("node").alias("m"), "ancestor", F.lit(step).alias("u2"))
        longer = a.where(F.col("u1") > 0).join(b, "m").select("node", "ancestor", (F.col("u1") + F.col("u2")).alias("up"))
        every = stored(every.unionByName(longer).distinct(), "closure")
        step *= 2
        far = stored(every.where(F.col("up") == step), "far")
    return every


def depths(closure: DataFrame) -> DataFrame:
    """node and depth: leaves have 1, a parent one more than its deepest child."""
    return closure.groupBy(F.col("ancestor").alias("node")).agg((F.max("up") + 1).alias("depth"))


def lca(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """a, b and lca: the common ancestor with the fewest steps from a."""
    one = closure.select(F.col("node").alias("a"), "ancestor", F.col("up").alias("ua"))
    two = closure.select(F.col("node").alias("b"), "ancestor")
    return pairs.select("a", "b").distinct().join(one, "a").join(two, ["b", "ancestor"]).groupBy("a", "b").agg(F.min_by("ancestor", "ua").alias("lca"))
