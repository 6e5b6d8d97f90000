"""Graph cleaning: abundance thresholds, tips, weak unitigs, abundance slices, smoothing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import smooth
from ..plans.storage import stored
from .graph import KmerGraph
from .paths import unitig_chains, without_tips


def histogram(graph: KmerGraph) -> DataFrame:
    """weight and n: how many k-mers have it."""
    return graph.kmers.groupBy("weight").agg(F.count("*").alias("n"))


def pick_threshold(counts: dict[int, int], fdr: float = 0.001, kept: float = 0.2) -> int:
    """Least weight to keep, -1 if none can be found.

    Rare k-mers are taken for errors whose mean is gamma distributed (a negative binomial
    count). Its shape is the one of 0.01 .. 2.00 whose ratio of successive ratios fits bins
    1 to 3. The threshold is the first weight at which errors are at most fdr of the k-mers;
    else where false positives fall under false negatives; else where what is lost outweighs
    the errors left. It must keep a share of the coverage.
    """
    top = max(10, max(counts, default=0) + 1)
    h = [0.0] + [float(counts.get(i, 0)) for i in range(1, top)]
    if not h[1] or not h[2]:
        return -1
    r1, r2 = h[2] / h[1], h[3] / h[2]

    def misfit(a: float) -> float:
        return abs(math.gamma(a) * math.gamma(a + 2) / (2 * math.gamma(a + 1) ** 2) - r2 / r1)

    a = min((i / 100 for i in range(1, 201)), key=misfit)
    b = max(math.gamma(a + 1) / (r1 * math.gamma(a)) - 1, 1.0)
    scale = h[1] * (b / (1 + b)) ** -a
    errors = [0.0] + [scale * math.exp(a * math.log(b) - math.lgamma(a) - math.lgamma(i) + math.lgamma(a + i - 1) - (a + i - 1) * math.log(1 + b)) for i in range(1, top)]

    def at_rate() -> int | None:
        return next((i for i in range(1, top) if h[i] and errors[i] / h[i] <= fdr), None)

    def running(good) -> int | None:
        e_sum = d_sum = 0.0
        e_left, d_left = sum(errors), sum(h)
        for i in range(1, top):
            e_sum, d_sum, e_left, d_left = e_sum + errors[i], d_sum + h[i], e_left - errors[i], d_left - h[i]
            if good(e_sum, d_sum, e_left, d_left):
                return i
        return None

    found = at_rate() or running(lambda e, d, el, dl: d > 0 and dl > 0 and 1 - e / d > el / dl) or running(lambda e, d, el, dl: d - e > el)
    if not found:
        return -1
    coverage = sum(i * n for i, n in enumerate(h))
    return found if sum(i * n for i, n in enumerate(h) if i >= found) >= kept * coverage else -1


def threshold(graph: KmerGraph, fallback: int | None = None, **options) -> int:
    """The estimated threshold, or the fallback; without one a failed estimate is an error. The driver holds the histogram."""
    t = pick_threshold({x.weight: x.n for x in histogram(graph).collect()}, **options)
    if t < 0 and fallback is None:
        raise ValueError("no abundance threshold could be estimated")
    return fallback if t < 0 else t


def count_filter(graph: KmerGraph, least: int = 1, most: int | None = None) -> KmerGraph:
    """k-mers with weights from least to most, both inclusive."""
    c = F.col("weight") >= least
    return graph.mask(c if most is None else c & (F.col("weight") <= most))


def weak_unitigs(graph: KmerGraph, chains: DataFrame, t: int) -> DataFrame:
    """head, n, weak and unreliable (more than half of its k-mers under t; never if t <= 1)."""
    weights = chains.join(graph.kmers, "kmer")
    return weights.groupBy("head").agg(F.count("*").alias("n"), F.count_if(F.col("weight") < t).alias("weak")).withColumn("unreliable", F.lit(t > 1) & (F.col("weak") * 2 > F.col("n")))


def clean(graph: KmerGraph, min_median: int = 1, tip_size: int = 0, least: int = 1, most: int | None = None) -> KmerGraph:
    """Filter by weight, then drop tips and unitigs of weak median."""
    graph = count_filter(graph, least, most)
    if tip_size <= 1 and min_median <= 1:
        return graph
    chains = stored(unitig_chains(graph), "clean")
    keep = without_tips(graph, chains, tip_size) if tip_size > 1 else chains
    if min_median > 1:
        keep = keep.join(weak_unitigs(graph, chains, min_median).where("unreliable").select("head"), "head", "left_anti")
    return graph._with(graph.kmers.join(keep.select("kmer"), "kmer", "left_semi"))


def count_slices(graph: KmerGraph, quantiles: list[float]) -> DataFrame:
    """slice (from 0), kmer, weight: between neighbouring quantiles of the weights, least inclusive, most exclusive.

    The first quantile 0 starts at weight 1, and 1 has no end.
    """
    h = histogram(graph)
    run = Window.orderBy("weight")  # a row a distinct weight
    cumulative = h.select("weight", F.sum("n").over(run).alias("upto"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    edges = [F.lit(1).cast("long") if q <= 0 else F.lit((1 << 63) - 1).cast("long") if q >= 1 else F.min(F.when(F.col("upto") >= F.lit(q) * F.col("total"), F.col("weight"))) for q in quantiles]
    row = cumulative.agg(*[e.alias(f"q{i}") if 0 < quantiles[i] < 1 else F.first(e).alias(f"q{i}") for i, e in enumerate(edges)])
    slices = row.select(F.posexplode(F.array(*[F.struct(F.col(f"q{i}").alias("lo"), F.col(f"q{i + 1}").alias("hi")) for i in range(len(quantiles) - 1)])).alias("slice", "e")).select("slice", "e.lo", "e.hi")
    return graph.kmers.join(F.broadcast(slices), (F.col("weight") >= F.col("lo")) & (F.col("weight") < F.col("hi"))).select("slice", "kmer", "weight")  # a row a slice


def smoothed(graph: KmerGraph, window: int, chains: DataFrame | None = None) -> DataFrame:
    """head, pos, kmer, weight and smooth: moving averages along unitigs."""
    chains = unitig_chains(graph) if chains is None else chains
    return chains.join(graph.kmers, "kmer").withColumn("smooth", smooth(["head"], "pos", "weight", window)).select("head", "pos", "kmer", "weight", "smooth")
