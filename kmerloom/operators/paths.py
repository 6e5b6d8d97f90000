"""Unitigs and contigs by pointer doubling: rounds of joins, each stored, as many as the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored
from .graph import KmerGraph


def _chains(nodes: DataFrame, successor: DataFrame) -> DataFrame:
    """head, pos and kmer of each path; successor: kmer and next, each at most once.

    Every node points some steps back; a round doubles the steps. Nodes that reach no
    head are on cycles, which are cut before their least k-mer, found on the way.
    """
    back = successor.select(F.col("next").alias("kmer"), F.col("kmer").alias("ptr"))
    now = stored(nodes.select("kmer").join(back, "kmer", "left").select("kmer", "ptr", F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.least("kmer", "ptr").alias("low"), F.col("ptr").isNull().alias("done")), "chain")
    n, rounds = nodes.count(), 0
    while 1 << rounds <= max(1, n) and not now.where("NOT done").isEmpty():
        there = now.select(F.col("kmer").alias("ptr"), F.col("ptr").alias("far"), F.col("dist").alias("more"), F.col("low").alias("lower"), F.col("done").alias("end"))
        left, reached = now.where("NOT done"), now.where("done")
        step = left.join(there, "ptr").select("kmer", F.when(F.col("end") & F.col("far").isNull(), F.col("ptr")).otherwise(F.col("far")).alias("ptr"), (F.col("dist") + F.col("more")).alias("dist"), F.least("low", "lower").alias("low"), F.col("end").alias("done"))
        before = left.count()
        now = stored(reached.unionByName(step), "chain")
        rounds += 1
        if now.where("NOT done").count() == before and (1 << rounds) > before:
            break  # only cycles are left, and their least k-mers are known
    paths = now.where("done").select(F.coalesce("ptr", "kmer").alias("head"), F.col("dist").alias("pos"), "kmer")
    cycles = now.where("NOT done").select("kmer", "low")
    if cycles.isEmpty():
        return paths
    cut = cycles.join(successor, "kmer").where("next <> low").select("kmer", "next")
    opened = _chains(cycles.select("kmer"), cut)
    return paths.unionByName(opened)


def _spelled(chains: DataFrame, k: int) -> DataFrame:
    """head, seq and n_kmers: the first k-mer and the last letters of the rest, in order."""
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.right("kmer", F.lit(1)).alias("c")))), lambda x: x.c), "")
    return chains.groupBy("head").agg(letters.alias("_l"), F.count("*").alias("n_kmers")).select("head", F.concat(F.left("head", F.lit(k - 1)), F.col("_l")).alias("seq"), "n_kmers")


def with_counts(graph: KmerGraph, chains: DataFrame) -> DataFrame:
    """head, seq, counts (one a k-mer, in order) and n_kmers of the chains' paths."""
    each = chains.join(graph.kmers, "kmer").groupBy("head").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "weight"))), lambda x: x.weight).alias("counts"))
    return _spelled(chains, graph.k).join(each, "head").select("head", "seq", "counts", "n_kmers")


def unitig_chains(graph: KmerGraph) -> DataFrame:
    """head, pos, kmer of the maximal non-branching paths: u to v where u has one successor and v one predecessor."""
    e = graph._ends()
    starts = e.groupBy(F.col("prefix").alias("j")).agg(F.count("*").alias("n"), F.min("kmer").alias("next")).where("n = 1")
    ends = e.groupBy(F.col("suffix").alias("j")).agg(F.count("*").alias("n"), F.min("kmer").alias("kmer")).where("n = 1")
    successor = stored(ends.select("j", "kmer").join(starts.select("j", "next"), "j").where("kmer <> next").select("kmer", "next"), "successors")
    return _chains(e.select("kmer"), successor)


def unitigs(graph: KmerGraph) -> DataFrame:
    return _spelled(unitig_chains(graph), graph.k)


def contig_chains(graph: KmerGraph) -> DataFrame:
    """head, pos, kmer of a path cover: at each (k-1)-mer predecessors and successors are paired by rank, so each k-mer is in one path."""
    e = graph._ends()
    into = e.selectExpr("kmer", "suffix AS j", "row_number() OVER (PARTITION BY suffix ORDER BY kmer) AS r")
    out = e.selectExpr("kmer AS next", "prefix AS j", "row_number() OVER (PARTITION BY prefix ORDER BY kmer) AS r")
    successor = stored(into.join(out, ["j", "r"]).where("kmer <> next").select("kmer", "next"), "successors")
    return _chains(e.select("kmer"), successor)


def contigs(graph: KmerGraph) -> DataFrame:
    return _spelled(contig_chains(graph), graph.k)


def primary_contigs(graph: KmerGraph) -> DataFrame:
    """Contigs that hold one of each pair of reverse-complementary k-mers."""
    from ..functions.kmers import canonical

    one = graph.both_strands().select(canonical(F.col("kmer"), graph.alphabet).alias("kmer"), F.lit(1).cast("long").alias("weight")).dropDuplicates(["kmer"])
    return contigs(KmerGraph(one, graph.k, graph.alphabet))


def without_tips(graph: KmerGraph, chains: DataFrame, tip_size: int) -> DataFrame:
    """chains without the unitigs of fewer than tip_size k-mers that are open at an end."""
    d = graph.degrees()
    ends = chains.groupBy("head").agg(F.count("*").alias("n"), F.max_by("kmer", "pos").alias("last"))
    with_in = ends.join(d.select(F.col("kmer").alias("head"), "indegree"), "head").join(d.select(F.col("kmer").alias("last"), "outdegree"), "last")
    tips = with_in.where((F.col("n") < tip_size) & (F.col("indegree") + F.col("outdegree") < 2))
    return chains.join(tips.select("head"), "head", "left_anti")


def gfa(graph: KmerGraph, compacted: bool = True) -> DataFrame:
    """line: a segment for each unitig (or k-mer) and a link of k - 1 letters for each overlap between them."""
    chains = stored(unitig_chains(graph), "gfa")
    named = graph.numbered().select("kmer", "node")
    overlap = f"{graph.k - 1}M"
    link = lambda a, b: F.concat_ws("\t", F.lit("L"), F.col(a).cast("string"), F.lit("+"), F.col(b).cast("string"), F.lit("+"), F.lit(overlap)).alias("line")
    edges = graph.edges()
    if compacted:
        last = chains.groupBy("head").agg(F.max_by("kmer", "pos").alias("last"))
        ids = last.join(named.select(F.col("kmer").alias("last"), "node"), "last")
        segments = _spelled(chains, graph.k).join(ids, "head").select(F.concat_ws("\t", F.lit("S"), F.col("node").cast("string"), "seq").alias("line"))
        a, b = ids.select(F.col("last").alias("source"), F.col("node").alias("a")), ids.select(F.col("head").alias("target"), F.col("node").alias("b"))
        links = edges.join(a, "source").join(b, "target").select(link("a", "b"))
    else:
        segments = named.select(F.concat_ws("\t", F.lit("S"), F.col("node").cast("string"), "kmer").alias("line"))
        a, b = (named.select(F.col("kmer").alias(x), F.col("node").alias(y)) for x, y in (("source", "a"), ("target", "b")))
        links = edges.join(a, "source").join(b, "target").select(link("a", "b"))
    header = graph.kmers.sparkSession.createDataFrame([("H\tVN:Z:1.0",)], "line string")
    return header.unionByName(segments).unionByName(links)


def gfa_paths(graph: KmerGraph, queries: DataFrame) -> DataFrame:
    """line: a path for each query through the nodes of its k-mers."""
    nodes = graph.map_report(queries).where("node > 0")
    steps = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda x: F.concat(x.node.cast("string"), F.lit("+"))), ",")
    return nodes.groupBy("query_id").agg(steps.alias("p"), F.count("*").alias("n")).select(F.concat_ws("\t", F.lit("P"), F.col("query_id").cast("string"), "p", F.array_join(F.array_repeat(F.lit(f"{graph.k - 1}M"), F.greatest(F.col("n") - 1, F.lit(1)).cast("int")), ",")).alias("line"))


def adjacency(graph: KmerGraph) -> DataFrame:
    """kmer and its successors, sorted, comma-joined; empty where there is none."""
    out = graph.edges().groupBy(F.col("source").alias("kmer")).agg(F.array_join(F.sort_array(F.collect_list("target")), ",").alias("successors"))
    return graph.both_strands().select("kmer").join(out, "kmer", "left").select("kmer", F.coalesce("successors", F.lit("")).alias("successors"))
