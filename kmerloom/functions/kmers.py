"""Sequences to k-mers.

Long strings are cut into overlapping chunks first: a substring is found by a walk from
the string's start, so without chunks the cost is quadratic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alphabet import BREAK, PROTEIN, Alphabet

CHUNK = 256


def spread(df: DataFrame) -> DataFrame:
    """Deal rows to all cores before they grow, if the input came in fewer parts."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def explode_kmers(df: DataFrame, seq: str, k: int, keep: list[str], alphabet: Alphabet = PROTEIN, step: int = CHUNK) -> DataFrame:
    """keep, n_kmers (all windows), pos (0-based) and kmer of every window of valid letters."""
    source = df.select(*keep, alphabet.normalise(seq).alias("_s")).withColumn("_n", F.char_length("_s") - (k - 1)).where("_n >= 1")
    chunks = source.select(*keep, F.col("_n").cast("long").alias("n_kmers"), F.posexplode(F.transform(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {step}").cast("int")), lambda c: F.substring(F.col("_s"), c * step + 1, F.lit(step + k - 1)))).alias("_c", "_ch"))
    out = chunks.select(*keep, "n_kmers", "_c", "_ch", F.explode(F.sequence(F.lit(1), F.char_length("_ch") - (k - 1))).alias("_j"))
    out = out.select(*keep, "n_kmers", (F.col("_c") * step + F.col("_j") - 1).cast("long").alias("pos"), F.substring(F.col("_ch"), F.col("_j"), F.lit(k)).alias("kmer"))
    return out.where(~F.contains("kmer", F.lit(BREAK))) if alphabet.unknown == BREAK else out


_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def fits_code(k: int, alphabet: Alphabet) -> bool:
    """Whether k letters are a number of 63 bits."""
    return len(alphabet.letters) <= len(_DIGITS) and len(alphabet.letters) ** k <= 1 << 63


def code(kmer: Column | str, alphabet: Alphabet) -> Column:
    """The k-mer as a number in base of its alphabet's letters; k-mers of one length keep their order."""
    n = len(alphabet.letters)
    return F.conv(F.translate(kmer, alphabet.letters, _DIGITS[:n]), n, 10).cast("long")


def canonical(kmer: Column | str, alphabet: Alphabet) -> Column:
    return F.least(kmer, alphabet.reverse_complement(kmer))


def next_kmer(kmer: Column, letter: Column) -> Column:
    return F.concat(F.substring(kmer, 2, 1 << 30), letter)


def prev_kmer(kmer: Column, letter: Column) -> Column:
    return F.concat(letter, F.substring(kmer, F.lit(1), F.char_length(kmer) - 1))
