"""Statistics of graphs, annotations and header indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import quantile
from .graph import KmerGraph


def graph_stats(graph: KmerGraph) -> DataFrame:
    """k, nodes, non-zero weights and their sum."""
    return graph.kmers.agg(F.lit(graph.k).alias("k"), F.count("*").alias("nodes"), F.count_if(F.col("weight") > 0).alias("nonzero"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight_sum"))


def letters(graph: KmerGraph) -> DataFrame:
    """place (first or last), letter and n."""
    each = graph.kmers.select(F.explode(F.array(F.struct(F.lit("first").alias("place"), F.left("kmer", F.lit(1)).alias("letter")), F.struct(F.lit("last").alias("place"), F.right("kmer", F.lit(1)).alias("letter")))).alias("x"))
    return each.groupBy("x.place", "x.letter").agg(F.count("*").alias("n"))


def annotation_stats(anno: DataFrame, graph: KmerGraph | None = None) -> DataFrame:
    """labels, objects, relations and density = relations / objects / labels; coordinates where there are some."""
    more = [F.sum(F.size("coords")).alias("coordinates")] if "coords" in anno.columns else []
    base = anno.agg(F.count_distinct("label").alias("labels"), F.count_distinct("kmer").alias("annotated"), F.count("*").alias("relations"), *more)
    objects = F.col("annotated") if graph is None else F.lit(graph.kmers.count())
    return base.withColumn("objects", objects.cast("long")).withColumn("density", F.col("relations") / F.col("objects") / F.col("labels")).drop("annotated")


def label_sizes(anno: DataFrame) -> DataFrame:
    return anno.groupBy("label").agg(F.count("*").alias("n_kmers"))


def count_histogram(anno: DataFrame) -> DataFrame:
    """label, count and n."""
    return anno.groupBy("label", "count").agg(F.count("*").alias("n"))


def count_quantile(anno: DataFrame, q: float) -> DataFrame:
    """label and quantile of its counts."""
    return quantile(count_histogram(anno), ["label"], "count", "n", q)


def header_stats(headers: DataFrame) -> DataFrame:
    return headers.agg(F.count_distinct("file").alias("columns"), F.count("*").alias("sequences"), F.sum("n_kmers").alias("kmers"))
