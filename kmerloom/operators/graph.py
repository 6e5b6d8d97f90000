"""k-mer graphs as DataFrames of (kmer, weight): construction, set operations, lookup, neighbours."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import PROTEIN, Alphabet
from ..functions.kmers import canonical, explode_kmers, fits_code
from ..functions.scan import count_kmers

MODES = ("basic", "canonical", "primary")


def saturated(c, width: int = 32):
    """Counts stop at the largest value of ``width`` bits."""
    return F.least(c, F.lit((1 << width) - 1).cast("long"))


@dataclass(frozen=True)
class KmerGraph:
    """kmers: kmer and weight, each k-mer once. In canonical and primary mode a k-mer stands for its reverse complement too."""

    kmers: DataFrame
    k: int
    alphabet: Alphabet = PROTEIN
    mode: str = "basic"

    # -- construction

    @staticmethod
    def build(sequences: DataFrame, k: int, alphabet: Alphabet = PROTEIN, mode: str = "basic", seq: str = "seq", count: str | None = None, width: int = 32, fwd_and_reverse: bool = False) -> KmerGraph:
        """Distinct k-mers with saturated counts; ``count`` names a weight of each sequence, else it is 1."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        source = sequences.select(F.col(seq).alias("seq"), (F.col(count) if count else F.lit(1)).cast("long").alias("cnt"))
        if fwd_and_reverse:
            source = source.unionByName(source.select(alphabet.reverse_complement(alphabet.normalise("seq")).alias("seq"), "cnt"))
        if count is None and fits_code(k, alphabet):
            return KmerGraph.from_counts(count_kmers(source, "seq", k, [], alphabet).withColumnRenamed("n", "cnt"), k, alphabet, mode, width)
        found = explode_kmers(source, "seq", k, ["cnt"], alphabet)
        return KmerGraph.from_counts(found.select("kmer", "cnt"), k, alphabet, mode, width)

    @staticmethod
    def from_counts(counts: DataFrame, k: int, alphabet: Alphabet = PROTEIN, mode: str = "basic", width: int = 32) -> KmerGraph:
        """counts: kmer and cnt, k-mers may repeat."""
        kmer = F.col("kmer") if mode == "basic" else canonical(F.col("kmer"), alphabet)
        return KmerGraph(counts.groupBy(kmer.alias("kmer")).agg(saturated(F.sum("cnt"), width).alias("weight")), k, alphabet, mode)

    @staticmethod
    def complete(spark: SparkSession, k: int, alphabet: Alphabet) -> KmerGraph:
        """All k-mers over the alphabet, by the digits of their numbers."""
        letters, n = alphabet.letters, len(alphabet.letters)
        digit = lambda i: F.substring(F.lit(letters), (F.expr(f"id div {n**i} % {n}") + 1).cast("int"), F.lit(1))
        return KmerGraph(spark.range(n**k).select(F.concat(*[digit(i) for i in reversed(range(k))]).alias("kmer"), F.lit(1).cast("long").alias("weight")), k, alphabet)

    def _with(self, kmers: DataFrame) -> KmerGraph:
        return replace(self, kmers=kmers)

    def _same(self, other: KmerGraph) -> None:
        if (self.k, self.alphabet, self.mode) != (other.k, other.alphabet, other.mode):
            raise ValueError("graphs must agree in k, alphabet and mode")

    def extend(self, sequences: DataFrame, seq: str = "seq", width: int = 32) -> KmerGraph:
        """The graph with the k-mers of more sequences; weights add up."""
        more = KmerGraph.build(sequences, self.k, self.alphabet, self.mode, seq, width=width)
        both = self.kmers.unionByName(more.kmers)
        return self._with(both.groupBy("kmer").agg(saturated(F.sum("weight"), width).alias("weight")))

    def merge(self, *others: KmerGraph, width: int = 32) -> KmerGraph:
        """Union of the k-mers; weights add up."""
        both = self.kmers
        for o in others:
            self._same(o)
            both = both.unionByName(o.kmers)
        return self._with(both.groupBy("kmer").agg(saturated(F.sum("weight"), width).alias("weight")))

    def difference(self, other: KmerGraph) -> DataFrame:
        """k-mers of one graph only, side: left or right."""
        self._same(other)
        a, b = self.kmers.select("kmer"), other.kmers.select("kmer")
        return a.join(b, "kmer", "left_anti").select("kmer", F.lit("left").alias("side")).unionByName(b.join(a, "kmer", "left_anti").select("kmer", F.lit("right").alias("side")))

    def equals(self, other: KmerGraph) -> bool:
        return self.difference(other).isEmpty()

    def both_strands(self) -> DataFrame:
        """kmer and weight, with the reverse complements that a canonical or primary graph stands for."""
        if self.mode == "basic":
            return self.kmers
        rc = self.kmers.select(self.alphabet.reverse_complement("kmer").alias("kmer"), "weight")
        return self.kmers.unionByName(rc).dropDuplicates(["kmer"])

    def mask(self, predicate) -> KmerGraph:
        """The subgraph of k-mers that satisfy a Column."""
        return self._with(self.kmers.where(predicate))

    def reverse_complemented(self) -> KmerGraph:
        return self._with(self.kmers.withColumn("kmer", self.alphabet.reverse_complement("kmer")))

    def count_range(self, least: int = 1, most: int | None = None) -> KmerGraph:
        """Weights from least (inclusive) to most (exclusive)."""
        c = F.col("weight") >= least
        return self.mask(c if most is None else c & (F.col("weight") < most))

    # -- lookup

    def _key(self, kmer):
        return kmer if self.mode == "basic" else canonical(kmer, self.alphabet)

    def map_kmers(self, queries: DataFrame, seq: str = "seq", keep: list[str] | None = None) -> DataFrame:
        """keep, n_kmers, pos, kmer and found for each window of the queries, by an outer equi-join."""
        q = explode_kmers(queries, seq, self.k, keep or ["query_id"], self.alphabet).withColumn("_key", self._key(F.col("kmer")))
        known = self.kmers.select(F.col("kmer").alias("_key"), F.lit(True).alias("found"))
        return q.join(known, "_key", "left").withColumn("found", F.coalesce("found", F.lit(False))).drop("_key")

    def numbered(self) -> DataFrame:
        """kmer, weight and node: 1-based rank, from sorted ranges, so no task sees all rows."""
        from .ranks import with_ranks

        return with_ranks(self.kmers, "kmer", "node")

    def map_report(self, queries: DataFrame, seq: str = "seq") -> DataFrame:
        """query_id, pos and node (0 where absent)."""
        q = explode_kmers(queries, seq, self.k, ["query_id"], self.alphabet).withColumn("_key", self._key(F.col("kmer")))
        return q.join(self.numbered().select(F.col("kmer").alias("_key"), "node"), "_key", "left").select("query_id", "pos", F.coalesce("node", F.lit(0).cast("long")).alias("node"))

    def map_count(self, queries: DataFrame, seq: str = "seq") -> DataFrame:
        """query_id, found, total and unique found k-mers."""
        return self.map_kmers(queries, seq).groupBy("query_id").agg(F.count_if("found").alias("found"), F.max("n_kmers").alias("total"), F.count_distinct(F.when(F.col("found"), self._key(F.col("kmer")))).alias("unique_found"))

    def presence(self, queries: DataFrame, fraction: float, seq: str = "seq") -> DataFrame:
        """query_id and present: at least n - floor(n * (1 - fraction)) windows are found."""
        hits = self.map_kmers(queries, seq).groupBy("query_id").agg(F.count_if("found").alias("found"), F.max("n_kmers").alias("n"))
        return hits.select("query_id", (F.col("found") >= F.col("n") - F.floor(F.col("n") * F.lit(1 - fraction))).alias("present"))

    def filter_present(self, queries: DataFrame, fraction: float, seq: str = "seq") -> DataFrame:
        """The queries that are present."""
        return queries.join(self.presence(queries, fraction, seq).where("present").select("query_id"), "query_id", "left_semi")

    def map_sub(self, queries: DataFrame, length: int, seq: str = "seq") -> DataFrame:
        """query_id, pos and the number of nodes that end in the query's window of ``length`` < k letters."""
        q = explode_kmers(queries, seq, length, ["query_id"], self.alphabet)
        ends = self.kmers.groupBy(F.right("kmer", F.lit(length)).alias("kmer")).agg(F.count("*").alias("nodes"))
        return q.join(ends, "kmer", "left").select("query_id", "pos", F.coalesce("nodes", F.lit(0).cast("long")).alias("nodes"))

    # -- neighbours

    def _ends(self) -> DataFrame:
        return self.both_strands().select("kmer", F.left("kmer", F.lit(self.k - 1)).alias("prefix"), F.substring("kmer", 2, self.k - 1).alias("suffix"))

    def edges(self) -> DataFrame:
        """source and target: the (k-1)-letter overlaps."""
        e = self._ends()
        return e.select(F.col("kmer").alias("source"), F.col("suffix").alias("_j")).join(e.select(F.col("kmer").alias("target"), F.col("prefix").alias("_j")), "_j").drop("_j")

    def degrees(self) -> DataFrame:
        """kmer, outdegree and indegree; two aggregates on (k-1)-mers instead of the edges."""
        e = self._ends()
        out = e.groupBy(F.col("prefix").alias("suffix")).agg(F.count("*").alias("outdegree"))
        into = e.groupBy(F.col("suffix").alias("prefix")).agg(F.count("*").alias("indegree"))
        zero = F.lit(0).cast("long")
        return e.join(out, "suffix", "left").join(into, "prefix", "left").select("kmer", F.coalesce("outdegree", zero).alias("outdegree"), F.coalesce("indegree", zero).alias("indegree"))

    def sources(self) -> DataFrame:
        """k-mers without a predecessor."""
        e = self._ends()
        return e.join(e.select(F.col("suffix").alias("prefix")), "prefix", "left_anti").select("kmer")

    def traverse(self, starts: DataFrame, letter: str) -> DataFrame:
        """kmer and next: the node reached by a letter, null where there is none."""
        step = starts.select("kmer", F.concat(F.substring("kmer", 2, self.k - 1), F.lit(letter)).alias("_n"))
        return step.join(self.both_strands().select(F.col("kmer").alias("next")), F.col("_n") == F.col("next"), "left").select("kmer", "next")

    def traverse_back(self, ends: DataFrame, letter: str) -> DataFrame:
        step = ends.select("kmer", F.concat(F.lit(letter), F.left("kmer", F.lit(self.k - 1))).alias("_n"))
        return step.join(self.both_strands().select(F.col("kmer").alias("previous")), F.col("_n") == F.col("previous"), "left").select("kmer", "previous")

    def hull(self, starts: DataFrame, depth: int, most_forks: int = 4) -> DataFrame:
        """kmer and depth of the nodes within ``depth`` steps; nodes with more than most_forks successors are not passed."""
        from ..plans.storage import stored

        passes = self.edges().join(self.degrees().where(F.col("outdegree") <= most_forks).select(F.col("kmer").alias("source")), "source", "left_semi")
        edges = stored(passes, "hull-edges")
        seen = stored(starts.select("kmer").distinct().withColumn("depth", F.lit(0)), "hull")
        for d in range(1, depth + 1):
            new = seen.where(F.col("depth") == d - 1).join(edges, F.col("kmer") == F.col("source")).select(F.col("target").alias("kmer")).distinct()
            new = new.join(seen, "kmer", "left_anti").withColumn("depth", F.lit(d))
            seen = stored(seen.unionByName(new), "hull")
        return seen
