"""Readers of sequence files, counts, variants, taxonomies and rules. All go through Spark's readers, compressed or not."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEQUENCE = "file string, seq_no long, name string, comment string, seq string"
# File extensions and the formats that they stand for.
_KINDS = {"fasta": "fasta", "fa": "fasta", "fas": "fasta", "ffn": "fasta", "fna": "fasta", "faa": "fasta", "fastq": "fastq", "fq": "fastq", "vcf": "vcf", "kmc_pre": "kmc", "kmc_suf": "kmc", "tsv": "counts", "parquet": "parquet"}


def file_format(path: str) -> str:
    """By extension, without that of a compression; anything else is FASTA."""
    name = re.sub(r"\.(gz|bgz|zst|bz2)$", "", path.rstrip("/").rpartition("/")[2].lower())
    return _KINDS.get(name.rpartition(".")[2], "fasta")


def _numbered(df: DataFrame, out: str = "n") -> DataFrame:
    """df (file, at, part: its partition; at: monotonically_increasing_id) with the number of each row in its file, from 0.

    Rows are counted by file and partition, and only these counts are summed up in order, so no task sees a whole file.
    """
    sizes = df.groupBy("file", "part").agg(F.count("*").alias("_m"), F.min("at").alias("_first"))
    before = sizes.selectExpr("file", "part", "_first", "sum(_m) OVER (PARTITION BY file ORDER BY part) - _m AS _before")
    return df.join(before, ["file", "part"]).withColumn(out, F.col("_before") + F.col("at") - F.col("_first")).drop("_before", "_first")


def _pieces(spark: SparkSession, path: str | list[str], separator: str | None) -> DataFrame:
    """file, part, at and value of the parts of text files; the same each time, as splits follow the files' sizes."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "value")


def _named(df: DataFrame, header: Column, seq: Column) -> DataFrame:
    return df.select("file", F.col("n").cast("long").alias("seq_no"), F.regexp_extract(header, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace(header, r"^\S*", "")).alias("comment"), seq.alias("seq"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records begin with ``>`` at a line's start; large files are read in parts."""
    parts = _numbered(_pieces(spark, path, "\n>")).where(F.trim(F.translate(F.regexp_replace("value", "^>", ""), "\r\n", "")) != "")
    clean = F.translate(F.regexp_replace("value", "^>", ""), "\r", "")
    return _named(parts, F.substring_index(clean, "\n", 1), F.translate(F.regexp_replace(clean, r"^[^\n]*", ""), "\n \t", ""))


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of four lines (@header, sequence, + with or without the name, quality of the same length); qualities are not kept.

    Lines are numbered in their file, whatever ends them, and four make a record. Anything else is an error; empty lines may follow the last record.
    """
    lines = _numbered(_pieces(spark, path, None), "line")
    four = lines.select("file", F.expr("line div 4").alias("n"), (F.col("line") % 4).alias("i"), "value").groupBy("file", "n").agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(x) for i, x in enumerate(("header", "seq", "plus", "quality"))])
    good = F.startswith("header", F.lit("@")) & F.startswith("plus", F.lit("+")) & (F.char_length("seq") == F.char_length("quality"))
    records = four.where("coalesce(header, '') <> '' OR coalesce(seq, '') <> '' OR coalesce(plus, '') <> '' OR coalesce(quality, '') <> ''")
    checked = records.withColumn("seq", F.when(F.coalesce(good, F.lit(False)), F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("malformed FASTQ record "), F.col("n").cast("string"), F.lit(" in "), F.col("file")))))
    return _named(checked, F.expr("substring(header, 2)"), F.col("seq"))


def read_string(spark: SparkSession, text: str) -> DataFrame:
    """FASTA in a string."""
    rows = []
    for i, part in enumerate(x for x in re.split(r"(?:^|\n)>", text) if x.strip()):
        head, _, seq = part.partition("\n")
        name, _, comment = head.strip().partition(" ")
        rows.append(("", i, name, comment.strip(), re.sub(r"\s", "", seq)))
    return spark.createDataFrame(rows, SEQUENCE)


def read_kmer_counts(spark: SparkSession, path: str) -> DataFrame:
    """file, k and counts (one a k-mer, over all sequences) of sidecar files: little-endian 32-bit k, then counts; gzip or plain."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for f in frames:
            out = []
            for file, content in zip(f["file"], f["content"], strict=True):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                out.append((file, struct.unpack_from("<I", data)[0], np.frombuffer(data, "<u4", offset=4).astype("int64").tolist()))
            yield pd.DataFrame(out, columns=["file", "k", "counts"])

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return files.mapInPandas(decode, "file string, k int, counts array<long>")


def read_fasta_counts(spark: SparkSession, path: str) -> DataFrame:
    """name, seq and counts (one a k-mer) of parts that ``write_fasta_counts`` wrote: each part's counts are dealt to its sequences in order."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for f in frames:
            for fasta, sidecar in zip(f["fasta"], f["counts"], strict=True):
                data = gzip.decompress(sidecar)
                k, numbers, at, out = struct.unpack_from("<I", data)[0], np.frombuffer(data, "<u4", offset=4).astype("int64"), 0, []
                for record in fasta.decode().split("\n>"):
                    name, _, seq = record.removeprefix(">").partition("\n")
                    seq = "".join(seq.split())
                    n = max(0, len(seq) - k + 1)
                    out.append((name, seq, numbers[at : at + n].tolist()))
                    at += n
                if at != len(numbers):
                    raise ValueError("counts and sequences do not agree")
                yield pd.DataFrame(out, columns=["name", "seq", "counts"])

    return spark.read.parquet(path).mapInPandas(decode, "name string, seq string, counts array<long>")


def header_abundance(comment: str | Column) -> Column:
    """The abundance of ``ka:f:`` or ``km:f:`` in a comment, rounded, 1 at least; null without one."""
    value = F.regexp_extract(comment, r"(?:ka|km):f:([0-9.eE+-]+)", 1)
    return F.when(value != "", F.greatest(F.lit(1), F.round(value.try_cast("double"))).cast("long"))


def with_reverse(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Each record and its reverse complement (reverse: true)."""
    from ..functions.alphabet import revcomp

    return df.withColumn("reverse", F.lit(False)).unionByName(df.withColumn(seq, revcomp(seq)).withColumn("reverse", F.lit(True)))


def count_runs(seqs: DataFrame, k: int) -> DataFrame:
    """seq_no, piece, seq, count: sequences with ``counts`` split where the count changes; pieces overlap by k - 1."""
    at = seqs.select("seq_no", "seq", F.posexplode("counts").alias("pos", "count"))
    run = F.expr("pos - row_number() OVER (PARTITION BY seq_no, count ORDER BY pos)")
    runs = at.withColumn("_r", run).groupBy("seq_no", "count", "_r").agg(F.min("pos").alias("piece"), F.count("*").cast("int").alias("n"), F.first("seq").alias("seq"))
    return runs.select("seq_no", "piece", F.substring("seq", F.col("piece") + 1, F.col("n") + (k - 1)).alias("seq"), "count")


def read_vcf(spark: SparkSession, path: str | list[str], reference: DataFrame, k: int, info: list[str] | None = None) -> DataFrame:
    """seq and labels of each passing allele: k letters of the reference before and after it.

    reference: name and seq. ``<CNn>`` repeats the reference allele n times, other symbolic alleles go. Labels are the
    contig, the entries of ``info`` that are set (a flag, or a value but 0; all flags if not given), and the samples
    of the file's own header that carry the allele.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    names = lines.where("value LIKE '#CHROM%'").select("file", F.slice(F.split("value", "\t"), 10, 1 << 20).alias("samples"))
    rows = lines.where("value NOT LIKE '#%' AND value <> ''").select("file", F.split("value", "\t").alias("f")).where("f[6] IN ('PASS', '.')").join(names, "file")
    alleles = rows.select(F.col("f")[0].alias("contig"), F.col("f")[1].cast("int").alias("at"), F.col("f")[3].alias("ref"), F.posexplode(F.split(F.col("f")[4], ",")).alias("i", "alt"), F.col("f")[7].alias("info"), F.slice("f", 10, 1 << 20).alias("calls"), "samples")
    copies = F.regexp_extract("alt", r"^<CN(\d+)>$", 1)
    alleles = alleles.withColumn("allele", F.when(copies != "", F.repeat("ref", copies.try_cast("int"))).when(~F.startswith("alt", F.lit("<")), F.col("alt"))).where("allele IS NOT NULL")
    carriers = F.transform(F.filter(F.arrays_zip(F.col("samples").alias("name"), F.col("calls").alias("call")), lambda x: F.array_contains(F.split(F.split(x["call"], ":")[0], "[/|]"), (F.col("i") + 1).cast("string"))), lambda x: x["name"])
    entries = F.filter(F.split("info", ";"), lambda x: x != ".")
    if info is None:
        flags = F.filter(entries, lambda x: ~F.contains(x, F.lit("=")))
    else:
        asked = F.array(*map(F.lit, info)).cast("array<string>")
        flags = F.filter(asked, lambda x: F.exists(entries, lambda e: (e == x) | (F.startswith(e, F.concat(x, F.lit("="))) & (e != F.concat(x, F.lit("=0"))))))
    joined = alleles.join(reference.select(F.col("name").alias("contig"), F.col("seq").alias("_ref")), "contig")
    before = F.substring("_ref", F.greatest(F.col("at") - k, F.lit(1)), F.least(F.col("at") - 1, F.lit(k)))
    after = F.substring("_ref", F.col("at") + F.char_length("ref"), F.lit(k))
    return joined.select("contig", "at", F.concat(before, "allele", after).alias("seq"), F.concat(F.array("contig"), flags, carriers).alias("labels"))


def read_counts(spark: SparkSession, path: str, least: int = 1, most: int | None = None, both_strands: bool = False) -> DataFrame:
    """kmer and cnt of Parquet or tab-separated counts; least inclusive, most exclusive."""
    df = spark.read.parquet(path) if file_format(path) == "parquet" else spark.read.schema("kmer string, cnt long").option("sep", "\t").csv(path)
    df = df.where(F.col("cnt") >= least) if most is None else df.where((F.col("cnt") >= least) & (F.col("cnt") < most))
    if both_strands:
        from ..functions.alphabet import revcomp

        df = df.unionByName(df.withColumn("kmer", revcomp("kmer"))).distinct()
    return df


def read_sequences(spark: SparkSession, path: str | list[str], kind: str | None = None) -> DataFrame:
    """FASTA, FASTQ or Parquet, by extension unless said."""
    kind = kind or file_format(path)
    readers = {"fasta": read_fasta, "fastq": read_fastq, "parquet": lambda s, p: s.read.parquet(p)}
    if kind not in readers:
        raise ValueError(f"{path}: {kind} has a reader of its own")
    return readers[kind](spark, path)


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The sequences of a list of files, of any of the formats; one read for each format."""
    kinds: dict[str, list[str]] = {}
    for p in paths:
        kinds.setdefault(file_format(p), []).append(p)
    out = None
    for kind, some in kinds.items():
        df = spark.read.parquet(*some) if kind == "parquet" else read_sequences(spark, some, kind)
        out = df if out is None else out.unionByName(df)
    return out


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """old and new of a file with a pair a line."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("old"), parts[1].alias("new"))


def read_linkage(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(*[parts[i].cast("double").cast("long").alias(c) for i, c in enumerate(("a", "b", "n_bits", "cluster"))])


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """child, parent, rank of a nodes file."""
    parts = F.split("value", r"\t\|\t?")
    return spark.read.text(path).select(parts[0].cast("long").alias("child"), parts[1].cast("long").alias("parent"), parts[2].alias("rank"))


def read_accessions(spark: SparkSession, path: str) -> DataFrame:
    """accession (with version) and taxid."""
    return spark.read.option("sep", "\t").option("header", True).csv(path).select(F.col("`accession.version`").alias("accession"), F.col("taxid").cast("long"))


def read_server_list(spark: SparkSession, path: str) -> dict[str, list[tuple[str, str]]]:
    """name to its (graph, annotation) paths; names may repeat."""
    out: dict[str, list[tuple[str, str]]] = {}
    for name, graph, anno in (x.value.split(",") for x in spark.read.text(path).where("trim(value) <> ''").collect()):
        out.setdefault(name.strip(), []).append((graph.strip(), anno.strip()))
    return out


def read_rule_file(spark: SparkSession, path: str) -> list:
    from ..operators.differential import read_rules as parse

    return parse("\n".join(x.value for x in spark.read.text(path, wholetext=True).collect()))

