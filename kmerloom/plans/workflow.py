"""From sample files to a searchable index: per-sample graphs, cleaned, a joint graph and its annotation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, Alphabet
from ..functions.kmers import canonical, explode_kmers
from ..operators import clean
from ..operators.graph import KmerGraph, saturated
from ..sources import readers, writers
from .query import Index
from .storage import dropped, stored


def sample_kmers(spark: SparkSession, samples: dict[str, list[str]], k: int, alphabet: Alphabet, mode: str, min_count: int, tip_size: int) -> DataFrame:
    """label, kmer and count of each sample's k-mers that its cleaning leaves.

    Without the removal of tips, which needs each sample's graph, all samples are one plan, keyed by label.
    """
    read = [(label, readers.read_many(spark, files)) for label, files in sorted(samples.items())]
    if tip_size <= 1:
        rows = reduce(DataFrame.unionByName, [df.select(F.lit(label).alias("label"), "seq") for label, df in read])
        windows = explode_kmers(rows, "seq", k, ["label"], alphabet)
        kmer = F.col("kmer") if mode == "basic" else canonical(F.col("kmer"), alphabet)
        return windows.groupBy("label", kmer.alias("kmer")).agg(saturated(F.count("*")).alias("count")).where(F.col("count") >= min_count)
    out = []
    for label, df in read:
        graph = clean.clean(KmerGraph.build(df, k, alphabet, mode), least=min_count, tip_size=tip_size)
        out.append(stored(graph.kmers.select(F.lit(label).alias("label"), "kmer", F.col("weight").alias("count")), "sample"))
    return reduce(DataFrame.unionByName, out)


def build_index(spark: SparkSession, samples: dict[str, list[str]], to: str, k: int = 31, alphabet: Alphabet = DNA, mode: str = "basic", min_count: int = 1, tip_size: int = 0, with_counts: bool = False) -> Index:
    """samples: label to its files. Writes a graph and an annotation to folder ``to``.

    A sample's contigs hold the k-mers of its cleaned graph, each once, so the joint graph and its annotation are built from these k-mers.
    """
    kmers = stored(sample_kmers(spark, samples, k, alphabet, mode, min_count, tip_size), "samples")
    weighed = kmers.select("kmer", (F.col("count") if with_counts else F.lit(1).cast("long")).alias("cnt"))
    writers.write_graph(KmerGraph.from_counts(weighed, k, alphabet, mode), f"{to}/graph")
    writers.write_annotation(kmers.select("kmer", "label", *["count"] * with_counts), f"{to}/annotation")
    dropped(kmers)
    return load_index(spark, to)


def load_index(spark: SparkSession, at: str) -> Index:
    graph = writers.read_graph(spark, f"{at}/graph")
    return Index(graph.k, graph.alphabet, stored=writers.read_annotation(spark, f"{at}/annotation"), mode=graph.mode)
