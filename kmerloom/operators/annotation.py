"""Annotations: which label has which k-mer, how often, and where. Long tables (kmer, label[, count][, coords])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import PROTEIN, Alphabet
from ..functions.kmers import explode_kmers, fits_code
from ..functions.scan import count_kmers
from .graph import KmerGraph, saturated


def _within(found: DataFrame, graph: KmerGraph | None) -> DataFrame:
    return found if graph is None else found.join(graph.kmers.select("kmer"), "kmer", "left_semi")


def labelled(sequences: DataFrame, *sources: Column) -> DataFrame:
    """A row for each sequence and label; sources are label columns or arrays of labels, put together."""
    arrays = [s if isinstance(s, Column) else F.col(s) for s in sources]
    if not arrays:
        raise ValueError("at least one source of labels is needed")
    return sequences.withColumn("label", F.explode(F.array_distinct(F.flatten(F.array(*arrays)))))


def annotate(sequences: DataFrame, k: int, label: str = "label", seq: str = "seq", alphabet: Alphabet = PROTEIN, graph: KmerGraph | None = None, only: DataFrame | None = None) -> DataFrame:
    """kmer, label: each pair once; ``only`` (kmer) restricts to some k-mers before the shuffle."""
    if only is None and fits_code(k, alphabet):
        return _within(count_kmers(sequences, seq, k, [label], alphabet).select("kmer", F.col(label).alias("label")), graph).distinct()
    found = explode_kmers(sequences, seq, k, [label], alphabet).select("kmer", F.col(label).alias("label"))
    if only is not None:
        found = found.join(only, "kmer", "left_semi")
    return _within(found, graph).distinct()


def annotate_counts(sequences: DataFrame, k: int, label: str = "label", seq: str = "seq", count: str | None = None, alphabet: Alphabet = PROTEIN, graph: KmerGraph | None = None, only: DataFrame | None = None, width: int = 32) -> DataFrame:
    """kmer, label, count: saturated sums."""
    if only is None and count is None and fits_code(k, alphabet):
        found = count_kmers(sequences, seq, k, [label], alphabet).select("kmer", F.col(label).alias("label"), "n")
        return _within(found, graph).groupBy("kmer", "label").agg(saturated(F.sum("n"), width).alias("count"))
    source = sequences.withColumn("_cnt", (F.col(count) if count else F.lit(1)).cast("long"))
    found = explode_kmers(source, seq, k, [label, "_cnt"], alphabet).select("kmer", F.col(label).alias("label"), "_cnt")
    if only is not None:
        found = found.join(only, "kmer", "left_semi")
    return _within(found, graph).groupBy("kmer", "label").agg(saturated(F.sum("_cnt"), width).alias("count"))


def starts(sequences: DataFrame, k: int, by: str, order: str, seq: str = "seq") -> DataFrame:
    """sequences with n_kmers and start: k-mers of the sequences before it with the same ``by``; short ones have none."""
    n = F.greatest(F.char_length(seq) - (k - 1), F.lit(0)).cast("long")
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sequences.withColumn("n_kmers", n).withColumn("start", F.coalesce(F.sum("n_kmers").over(w), F.lit(0).cast("long")))


def placed(sequences: DataFrame, k: int, label: str = "label", order: str = "seq_id", seq: str = "seq") -> DataFrame:
    """sequences with start, the k-mers of the sequences before them in their label."""
    return sequences.join(offsets(sequences, k, label, order, seq), [order, label])


def offsets(sequences: DataFrame, k: int, label: str = "label", order: str = "seq_id", seq: str = "seq") -> DataFrame:
    """order, label and start of each sequence."""
    small = sequences.select(order, label, F.char_length(seq).alias("_len"))
    n = F.greatest(F.col("_len") - (k - 1), F.lit(0)).cast("long")
    w = Window.partitionBy(label).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return small.select(order, label, F.coalesce(F.sum(n).over(w), F.lit(0).cast("long")).alias("start"))


def annotate_coords(sequences: DataFrame, k: int, label: str = "label", order: str = "seq_id", seq: str = "seq", per_sequence: bool = False, alphabet: Alphabet = PROTEIN, only: DataFrame | None = None) -> DataFrame:
    """kmer, label, coords: sorted offsets that run over the sequences of a label, or restart with each.

    Only the small columns go through the window; the texts are joined to their starts. ``order`` numbers the
    sequences of a label; other labels may use the same numbers.
    """
    source = sequences.withColumn("start", F.lit(0).cast("long")) if per_sequence else placed(sequences, k, label, order, seq)
    found = explode_kmers(source, seq, k, [label, "start"], alphabet)
    if only is not None:
        found = found.join(only, "kmer", "left_semi")
    return found.groupBy("kmer", F.col(label).alias("label")).agg(F.sort_array(F.collect_list(F.col("start") + F.col("pos"))).alias("coords"))


def header_index(sequences: DataFrame, k: int, file: str = "file", order: str = "seq_id", header: str = "name", seq: str = "seq") -> DataFrame:
    """file, seq_no, header, start, n_kmers; neighbours with equal headers are one."""
    placed = starts(sequences.select(file, order, header, seq), k, file, order, seq).drop(seq).where("n_kmers > 0")
    w = Window.partitionBy(file).orderBy(order)
    run = F.sum(F.when(F.lag(header).over(w).eqNullSafe(F.col(header)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)).over(w)
    return placed.withColumn("seq_no", run).groupBy(file, "seq_no", F.col(header).alias("header")).agg(F.min("start").alias("start"), F.sum("n_kmers").alias("n_kmers"))


def locate(coords: DataFrame, headers: DataFrame, by: str = "file", bucket: int = 4096) -> DataFrame:
    """coords (by, coord) with header, seq_no and local coordinate.

    A range join by buckets of coordinates: an equi-join, so neither side is broadcast or crossed.
    """
    spans = headers.withColumn("_b", F.explode(F.sequence(F.expr(f"start div {bucket}"), F.expr(f"(start + n_kmers - 1) div {bucket}"))))
    return coords.withColumn("_b", F.expr(f"coord div {bucket}")).join(spans, [by, "_b"]).where("coord >= start AND coord < start + n_kmers").withColumn("local", F.col("coord") - F.col("start")).drop("_b")


def encode_labels(anno: DataFrame) -> DataFrame:
    """label and label_id, dense from 0 by label."""
    from .ranks import with_ranks

    return with_ranks(anno.select("label").distinct(), "label", "_r").select("label", (F.col("_r") - 1).cast("int").alias("label_id"))


def rename(anno: DataFrame, rules: DataFrame) -> DataFrame:
    """anno with labels renamed by rules (old, new); columns that then collide are merged."""
    renamed = anno.join(rules, F.col("label") == F.col("old"), "left").withColumn("label", F.coalesce("new", "label")).drop("old", "new")
    values = [F.sum("count").alias("count")] if "count" in anno.columns else []
    values += [F.array_sort(F.flatten(F.collect_list("coords"))).alias("coords")] if "coords" in anno.columns else []
    return renamed.groupBy("kmer", "label").agg(*values) if values else renamed.select("kmer", "label").distinct()


def merge(*annos: DataFrame) -> DataFrame:
    """Union; counts of the same k-mer and label add up."""
    both = annos[0]
    for a in annos[1:]:
        both = both.unionByName(a)
    if "count" in both.columns:
        return both.groupBy("kmer", "label").agg(saturated(F.sum("count")).alias("count"))
    return both.select("kmer", "label").distinct()


def labels_of(anno: DataFrame, kmers: DataFrame) -> DataFrame:
    """kmer and its sorted labels."""
    return anno.join(kmers.select("kmer"), "kmer", "left_semi").groupBy("kmer").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def kmers_of(anno: DataFrame, *labels: str) -> DataFrame:
    return anno.where(F.col("label").isin(list(labels))).select("kmer", "label")


def sum_rows(anno: DataFrame, rows: DataFrame, min_count: int = 1) -> DataFrame:
    """label, matches and, with counts, value_sum, over rows (kmer, n): n weighs a k-mer; labels under min_count go."""
    hits = anno.join(rows, "kmer")
    values = [F.sum(F.col("count") * F.col("n")).alias("value_sum")] if "count" in anno.columns else []
    return hits.groupBy("label").agg(F.sum("n").alias("matches"), *values).where(F.col("matches") >= min_count)


def encoded(anno: DataFrame, ids: DataFrame) -> DataFrame:
    """kmer and label_id."""
    return anno.join(ids, "label").drop("label")


def decoded(anno: DataFrame, ids: DataFrame) -> DataFrame:
    """kmer, label_id and label."""
    return anno.join(ids, "label_id")


def exists(anno: DataFrame, labels: DataFrame) -> DataFrame:
    """label and whether the annotation has it."""
    known = anno.select("label").distinct().withColumn("exists", F.lit(True))
    return labels.join(known, "label", "left").select("label", F.coalesce("exists", F.lit(False)).alias("exists"))


def rows_for(graph: KmerGraph, anno: DataFrame) -> DataFrame:
    """kmer and n_labels for every k-mer of a graph, 0 for those that were added after the annotation."""
    return graph.kmers.select("kmer").join(anno.select("kmer", "label"), "kmer", "left").groupBy("kmer").agg(F.count("label").alias("n_labels"))


def distinct_rows(anno: DataFrame, kmers: DataFrame) -> DataFrame:
    """labels and n_rows of the distinct rows among those of some k-mers."""
    return labels_of(anno, kmers).groupBy("labels").agg(F.count("*").alias("n_rows"))
