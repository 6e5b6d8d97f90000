"""Writers: FASTA, GFA, text, Parquet layouts of graphs and annotations."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import ALPHABETS
from ..operators.columns import colours
from ..operators.graph import KmerGraph
from ..operators.ranks import with_ranks
from ..plans.storage import stored


def fasta_lines(df: DataFrame, header: str | None = None, name: str | None = None, seq: str = "seq") -> DataFrame:
    """value: two lines a sequence. The header is a column's, or the given text, numbered if several share it."""
    head = F.col(name).cast("string") if name else F.lit(header or "")
    return df.select(F.concat(F.lit(">"), head, F.lit("\n"), F.col(seq)).alias("value"))


def write_fasta(df: DataFrame, path: str, header: str | None = None, name: str | None = None, seq: str = "seq", compression: str = "gzip", mode: str = "errorifexists") -> None:
    fasta_lines(df, header, name, seq).write.mode(mode).option("compression", compression).text(path)


def write_fasta_counts(df: DataFrame, path: str, k: int, name: str, seq: str = "seq", counts: str = "counts") -> None:
    """FASTA in part files, with a sidecar of the same part name: little-endian 32-bit k, then a count for each k-mer of the part's sequences, in order."""

    def parts(frames):
        for f in frames:
            lines = "".join(f">{n}\n{s}\n" for n, s in zip(f["name"], f["seq"], strict=True))
            numbers = np.concatenate([np.asarray(x, "<u4") for x in f["counts"]]) if len(f) else np.zeros(0, "<u4")
            yield pd.DataFrame({"fasta": [lines.encode()], "counts": [gzip.compress(struct.pack("<I", k) + numbers.tobytes())]})

    rows = df.select(F.col(name).cast("string").alias("name"), F.col(seq).alias("seq"), F.col(counts).alias("counts"))
    rows.mapInPandas(parts, "fasta binary, counts binary").write.parquet(path)


def write_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    df.select(F.col(df.columns[0]).alias("value")).write.option("compression", compression).text(path)


def write_graph(graph: KmerGraph, path: str, parts: int | None = None) -> None:
    """Sorted ranges of k-mers, so row groups can be skipped; k, alphabet and mode lie beside."""
    df = graph.kmers.repartitionByRange(parts, "kmer") if parts else graph.kmers.repartitionByRange("kmer")
    df.sortWithinPartitions("kmer").write.parquet(f"{path}/kmers")
    graph.kmers.sparkSession.createDataFrame([(graph.k, graph.alphabet.name, graph.mode)], "k int, alphabet string, mode string").write.json(f"{path}/about")


def read_graph(spark: SparkSession, path: str) -> KmerGraph:
    about = spark.read.schema("k int, alphabet string, mode string").json(f"{path}/about").first()
    return KmerGraph(spark.read.parquet(f"{path}/kmers"), about.k, ALPHABETS[about.alphabet], about.mode)


def write_annotation(anno: DataFrame, path: str, separately: bool = False) -> None:
    """One table by k-mer, or a folder a label."""
    if separately:
        anno.repartition("label", F.pmod(F.xxhash64("kmer"), F.lit(16))).write.partitionBy("label").parquet(path)
    else:
        anno.repartitionByRange("kmer").sortWithinPartitions("kmer").write.parquet(path)


def read_annotation(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def append_annotation(more: DataFrame, path: str) -> None:
    """Add to a stored annotation; readers put equal rows together (``annotation.merge``)."""
    more.repartitionByRange("kmer").sortWithinPartitions("kmer").write.mode("append").parquet(path)


def write_colours(anno: DataFrame, path: str) -> None:
    """A table of k-mers with a number each for their set of labels, and one of the sets."""
    each = stored(colours(anno), "colours")
    each.select("kmer", "colour").repartitionByRange("kmer").sortWithinPartitions("kmer").write.parquet(f"{path}/kmers")
    each.select("colour", "labels").distinct().write.parquet(f"{path}/colours")


def read_colours(spark: SparkSession, path: str) -> DataFrame:
    """kmer and label."""
    sets = spark.read.parquet(f"{path}/colours").select("colour", F.explode(F.from_json("labels", "array<string>")).alias("label"))
    return spark.read.parquet(f"{path}/kmers").join(sets, "colour").select("kmer", "label")


def write_text_columns(anno: DataFrame, path: str) -> None:
    """A text folder a label with its k-mers."""
    anno.select("label", F.col("kmer").alias("value")).repartition("label", F.pmod(F.xxhash64("value"), F.lit(16))).write.partitionBy("label").text(path)


def merge_gfa(graph_lines: DataFrame, path_lines: DataFrame) -> DataFrame:
    """Lines of a graph and of paths, with the paths numbered anew from 1, in order of their names."""
    paths = path_lines.select(F.split("line", "\t").alias("f")).select(F.col("f")[1].alias("name"), "f")
    fresh = with_ranks(paths, "name", "n")
    return graph_lines.unionByName(fresh.select(F.concat_ws("\t", F.lit("P"), F.col("n").cast("string"), F.col("f")[2], F.col("f")[3]).alias("line")))
