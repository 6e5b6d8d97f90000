"""Differential assembly: k-mers that a group of labels has and another has not, by k-mer or by unitig."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import KmerGraph


@dataclass
class Rule:
    """Fractions of labels and of a unitig's k-mers; the defaults are those of a rules file."""

    name: str
    in_labels: list[str]
    out_labels: list[str]
    in_min_fraction: float = 1.0
    out_max_fraction: float = 0.0
    unitig_in_min_fraction: float = 0.0
    unitig_out_max_fraction: float = 1.0
    unitig_other_max_fraction: float = 1.0
    shared_labels: list[str] = field(default_factory=list)
    with_complement: bool = False


def read_rules(text: str) -> list[Rule]:
    """Rules of a JSON text; commas before a closing bracket are allowed. Shared labels last until a group names others."""
    found, shared = [], []
    for group in json.loads(re.sub(r",(\s*[\]}])", r"\1", text)).get("groups", []):
        shared = group.get("shared_labels", shared)
        for x in group.get("experiments", []):
            known = {k: x[k] for k in ("in_min_fraction", "out_max_fraction", "unitig_in_min_fraction", "unitig_out_max_fraction", "unitig_other_max_fraction") if k in x}
            if not x.get("in"):
                raise ValueError("an experiment needs labels in 'in'")
            found.append(Rule(x.get("name", ""), x["in"], x.get("out", []), shared_labels=shared, **known))
    return found


def label_counts(anno: DataFrame, rule: Rule) -> DataFrame:
    """kmer, n_in, n_out and other (it has a label of neither side) for k-mers with a label of either side."""
    inside, outside = F.col("label").isin(rule.in_labels), F.col("label").isin(rule.out_labels) if rule.out_labels else F.lit(False)
    counted = anno.groupBy("kmer").agg(F.count_if(inside).alias("n_in"), F.count_if(outside).alias("n_out"), (F.count_if(~inside & ~outside & (~F.col("label").isin(rule.shared_labels) if rule.shared_labels else F.lit(True))) > 0).alias("other"))
    return counted.where("n_in + n_out > 0")


def cutoffs(rule: Rule) -> tuple[int, int]:
    return math.ceil(rule.in_min_fraction * len(rule.in_labels)), math.floor(rule.out_max_fraction * len(rule.out_labels))


def by_node(anno: DataFrame, rule: Rule) -> DataFrame:
    """k-mers with at least the least in-labels and at most the most out-labels."""
    least, most = cutoffs(rule)
    return label_counts(anno, rule).where((F.col("n_in") >= max(1, least)) & (F.col("n_out") <= most)).select("kmer", "n_in", "n_out")


def by_unitig(graph: KmerGraph, anno: DataFrame, rule: Rule, chains: DataFrame | None = None) -> DataFrame:
    """head, pos, kmer of the unitig parts that stay, each from its first to its last in-k-mer.

    The unitigs are those of the k-mers with a label of either side.
    """
    from ..plans.storage import stored
    from .paths import unitig_chains

    least, most = cutoffs(rule)
    counts = stored(label_counts(anno, rule), "diff-counts")
    if chains is None:
        chains = stored(unitig_chains(graph._with(graph.kmers.join(counts.select("kmer"), "kmer", "left_semi"))), "diff-unitigs")
    marked = chains.join(counts, "kmer").withColumn("is_in", F.col("n_in") >= max(1, least)).withColumn("is_out", F.col("n_out") > most)
    span = marked.where("is_in").groupBy("head").agg(F.min("pos").alias("begin"), F.max("pos").alias("last"), F.count("*").alias("n_in_kmers"))
    size = F.col("last") - F.col("begin") + 1
    inner = marked.join(span, "head").where("pos BETWEEN begin AND last")
    judged = inner.groupBy("head", "begin", "last", "n_in_kmers").agg(F.count_if("is_out").alias("outs"), F.count_if("other").alias("others"))
    kept = judged.where((F.col("n_in_kmers") >= F.ceil(F.lit(rule.unitig_in_min_fraction) * size)) & (F.col("outs") <= F.floor(F.lit(rule.unitig_out_max_fraction) * size)) & (F.col("others") <= F.floor(F.lit(rule.unitig_other_max_fraction) * size)))
    return inner.join(kept.select("head"), "head", "left_semi").select("head", "pos", "kmer")


def assemble(graph: KmerGraph, anno: DataFrame, rule: Rule, by: str = "node", unitigs: bool = False) -> DataFrame:
    """Sequences of the differential subgraph."""
    from ..plans.storage import stored
    from . import paths

    kmers = (by_node(anno, rule) if by == "node" else by_unitig(graph, anno, rule)).select("kmer")
    sub = graph._with(stored(graph.kmers.join(kmers, "kmer", "left_semi"), "diff-graph"))
    return (paths.unitigs if unitigs else paths.contigs)(sub)
