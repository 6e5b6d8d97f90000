"""Indexes that grow with a stream of sequence rows: each micro-batch is counted and appended, readers sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.alphabet import PROTEIN, Alphabet
from ..functions.kmers import explode_kmers


def follow(stream: DataFrame, to: str, checkpoint: str, k: int, alphabet: Alphabet = PROTEIN) -> StreamingQuery:
    """stream: label and seq. Each batch's (kmer, label, count) goes to its own folder, so a batch that is run again replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        counts = explode_kmers(batch, "seq", k, ["label"], alphabet).groupBy("kmer", "label").agg(F.count("*").alias("count"))
        counts.write.mode("overwrite").parquet(f"{to}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def annotation(spark: SparkSession, at: str) -> DataFrame:
    """kmer, label, count over all batches so far."""
    return spark.read.parquet(at).groupBy("kmer", "label").agg(F.sum("count").alias("count"))
