"""Operations on label columns: aggregates, overlaps, similarities, clustering, row classes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import saturated


def bounds(n_labels: int, least: float = 0, most: float | None = None, fraction: bool = False) -> tuple[int, int]:
    """Least and most labels as numbers: a fraction's least is rounded up, its most down; the least is 1 at least."""
    if fraction:
        least, most = math.ceil(least * n_labels), math.floor((1.0 if most is None else most) * n_labels)
    return max(1, int(least)), n_labels if most is None else int(most)


def aggregate(anno: DataFrame, least: int = 1, most: int | None = None, min_value: int = 1, max_value: int | None = None, width: int = 32) -> DataFrame:
    """kmer, n_labels and total: k-mers with from least to most labels whose value is in the range, and the sum of those values."""
    value = F.col("count") if "count" in anno.columns else F.lit(1)
    ok = value >= min_value
    if max_value is not None:
        ok &= value <= max_value
    out = anno.where(ok).groupBy("kmer").agg(F.count("*").alias("n_labels"), saturated(F.sum(value), width).cast("long").alias("total")).where(F.col("n_labels") >= max(1, least))
    return out if most is None else out.where(F.col("n_labels") <= most)


def overlap(base: DataFrame, other: DataFrame, min_count: int = 1) -> DataFrame:
    """label_a (of base), label_b and shared: k-mers in both columns.

    k-mers with the same two sets of labels are counted together first, so pairs of labels are made once
    for each pair of sets, not for each k-mer.
    """
    a = base.groupBy("kmer").agg(F.sort_array(F.collect_set("label")).alias("a"))
    b = other.groupBy("kmer").agg(F.sort_array(F.collect_set("label")).alias("b"))
    sets = a.join(b, "kmer").groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = sets.select("n", "b", F.explode("a").alias("label_a")).select("n", "label_a", F.explode("b").alias("label_b"))
    return pairs.groupBy("label_a", "label_b").agg(F.sum("n").alias("shared")).where(F.col("shared") >= min_count)


def similarity(anno: DataFrame) -> DataFrame:
    """label_a < label_b, shared, ratio (shared over all k-mers) and jaccard."""
    pairs = overlap(anno, anno).where("label_a <= label_b")
    total = anno.select("kmer").distinct().count()
    sizes = pairs.where("label_a = label_b").select(F.col("label_a").alias("label"), F.col("shared").alias("size"))
    both = pairs.where("label_a < label_b")
    a, b = (sizes.select(F.col("label").alias(f"label_{s}"), F.col("size").alias(f"size_{s}")) for s in "ab")
    return both.join(a, "label_a").join(b, "label_b").select("label_a", "label_b", "shared", (F.col("shared") / F.lit(total)).alias("ratio"), (F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).alias("jaccard"))


def greedy_match(pairs: list[tuple[str, str, float]], order: list[str]) -> list[tuple[str, ...]]:
    """Pairs of columns by similarity, ties by closeness in the order; what is left over stays alone."""
    at = {x: i for i, x in enumerate(order)}
    known = {(a, b): s for a, b, s in pairs} | {(b, a): s for a, b, s in pairs}
    every = [(-known.get((a, b), 0.0), j - i, i, a, b) for i, a in enumerate(order) for j, b in enumerate(order) if i < j]
    free, out = set(order), []
    for _, _, _, a, b in sorted(every):
        if a in free and b in free:
            free -= {a, b}
            out.append((a, b))
    return out + [(x,) for x in sorted(free, key=at.__getitem__)]


def linkage(anno: DataFrame, sample: int | None = None) -> list[tuple[int, int, int, int]]:
    """Agglomerative clustering of the columns: (cluster, cluster, size of the union, new cluster).

    Labels, numbered by name, are few and stay on the driver; their k-mers do not.
    """
    from ..plans.storage import stored

    rows = subsample(anno, sample) if sample else anno
    names = sorted(x.label for x in rows.select("label").distinct().collect())
    number = {x: i for i, x in enumerate(names)}
    now = stored(rows.select("kmer", "label").distinct(), "linkage")
    cluster = dict(number)
    out, fresh = [], len(names)
    while len(set(cluster.values())) > 1:
        pairs = [(x.label_a, x.label_b, x.shared) for x in overlap(now, now).where("label_a < label_b").collect()]
        order = sorted(cluster, key=cluster.__getitem__)
        rules = []
        for group in greedy_match(pairs, order):
            if len(group) == 2:
                rules.append((group, fresh))
                fresh += 1
        mapping = F.create_map(*[F.lit(x) for g, new in rules for name in g for x in (name, f"#{new}")])
        now = stored(now.select("kmer", F.coalesce(mapping[F.col("label")], F.col("label")).alias("label")).distinct(), "linkage")
        sizes = {x.label: x["count"] for x in now.groupBy("label").count().collect()}
        for (a, b), new in rules:
            out.append((cluster.pop(a), cluster.pop(b), sizes[f"#{new}"], new))
            cluster[f"#{new}"] = new
    return out


def subsample(anno: DataFrame, one_in: int) -> DataFrame:
    """The rows of about one in so many k-mers, the same ones each time."""
    return anno.where(F.pmod(F.xxhash64("kmer"), F.lit(one_in)) == 0)


def row_classes(anno: DataFrame) -> DataFrame:
    """labels (sorted, comma-joined) and n_kmers of the distinct annotation rows."""
    return anno.groupBy("kmer").agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels")).groupBy("labels").agg(F.count("*").alias("n_kmers"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("kmer").intersect(b.select("kmer"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("kmer").union(b.select("kmer")).distinct()


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("kmer").exceptAll(b.select("kmer")).distinct()


def colours(anno: DataFrame) -> DataFrame:
    """kmer and colour: a number for each distinct set of labels."""
    from .ranks import with_ranks

    sets = anno.groupBy("kmer").agg(F.to_json(F.sort_array(F.collect_set("label"))).alias("labels"))
    return with_ranks(sets, "labels", "colour").select("kmer", "colour", "labels")


def row_diff(anno: DataFrame, edges: DataFrame) -> DataFrame:
    """kmer, next and label: the rows as differences from that of a successor (the least greater one), an anchor's (next null) as it is.

    A label is in the difference where one of both rows has it. As successors are greater, no path turns back.
    """
    follow = edges.where("target > source").groupBy(F.col("source").alias("kmer")).agg(F.min("target").alias("next"))
    rows = anno.select("kmer", "label").distinct()
    linked = rows.select("kmer").distinct().join(follow, "kmer", "left").join(rows.select(F.col("kmer").alias("next")).distinct().withColumn("there", F.lit(True)), "next", "left")
    linked = linked.select("kmer", F.when(F.col("there"), F.col("next")).alias("next"))
    own = linked.join(rows, "kmer").select("kmer", "next", "label")
    other = linked.where("next IS NOT NULL").join(rows.select(F.col("kmer").alias("next"), "label"), "next").select("kmer", "next", "label")
    both = own.unionByName(other).groupBy("kmer", "next", "label").count().where("count = 1").drop("count")
    return linked.join(both.select("kmer", "label"), "kmer", "left").select("kmer", "next", "label")


def from_row_diff(diff: DataFrame) -> DataFrame:
    """kmer and label: a row is the labels that an odd number of the rows on its way to an anchor has; ways are doubled a round."""
    from ..plans.storage import stored

    now = stored(diff.select("kmer", F.col("next").alias("ptr")).distinct(), "ways")
    sums = stored(diff.where("label IS NOT NULL").select("kmer", "label"), "sums")
    while not now.where("ptr IS NOT NULL").isEmpty():
        further = now.select("kmer", "ptr").join(sums.select(F.col("kmer").alias("ptr"), "label"), "ptr").select("kmer", "label")
        sums = stored(sums.unionByName(further).groupBy("kmer", "label").count().where("count % 2 = 1").drop("count"), "sums")
        now = stored(now.join(now.select(F.col("kmer").alias("ptr"), F.col("ptr").alias("far")), "ptr", "left").select("kmer", F.col("far").alias("ptr")), "ways")
    return sums
