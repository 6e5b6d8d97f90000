"""Alignment of queries to the graph: seeds as joins and windows, extension in one task a query (and label)."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions.kmers import explode_kmers
from ..functions.text import islands
from ..plans.storage import stored
from .graph import KmerGraph


def _seeds(hits: DataFrame, key: list[str], k: int, min_match: float) -> DataFrame:
    """key, first and last of the runs of hits (key, n_kmers, pos); where the covered letters are under the share, all go."""
    runs = islands(hits.select(*key, "n_kmers", "pos", F.lit(1).alias("one")), [*key, "n_kmers"], "pos", "one").drop("one")
    covered = runs.withColumn("_p", F.coalesce(F.lag("last").over(Window.partitionBy(*key).orderBy("first")), F.lit(-k).cast("long")))
    share = covered.groupBy(*key).agg((F.sum(F.col("last") + k - F.greatest("first", F.col("_p") + k)) / (F.max("n_kmers") + k - 1)).alias("share"))
    return runs.join(share.where(F.col("share") >= min_match).select(*key), key, "left_semi").select(*key, "first", "last")


def exact_seeds(graph: KmerGraph, queries: DataFrame, min_match: float = 0.0) -> DataFrame:
    """query_id, first and last window of each run of found k-mers; queries whose covered letters are under the share go."""
    return _seeds(graph.map_kmers(queries).where("found"), ["query_id"], graph.k, min_match)


def mem_seeds(graph: KmerGraph, queries: DataFrame) -> DataFrame:
    """query_id, first, last: runs of found k-mers, ended after a k-mer with several successors and before one with several predecessors."""
    hits = graph.map_kmers(queries).where("found").select("query_id", "pos", graph._key(F.col("kmer")).alias("kmer"))
    d = graph.degrees()
    w = Window.partitionBy("query_id").orderBy("pos")
    flagged = hits.join(d, "kmer").withColumn("cut", (F.lag("pos").over(w) + 1 != F.col("pos")) | (F.lag("outdegree").over(w) > 1) | (F.col("indegree") > 1))
    return flagged.withColumn("run", F.sum(F.when(F.col("cut"), 1).otherwise(0)).over(w)).groupBy("query_id", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).select("query_id", "first", "last")


def suffix_seeds(graph: KmerGraph, queries: DataFrame, length: int, most: int = 1000) -> DataFrame:
    """query_id, pos, kmer: nodes that end in a window of ``length`` letters, where no more than ``most`` do."""
    q = explode_kmers(queries, "seq", length, ["query_id"], graph.alphabet).select("query_id", "pos", F.col("kmer").alias("part"))
    ends = graph.kmers.select(F.right("kmer", F.lit(length)).alias("part"), "kmer")
    few = ends.groupBy("part").count().where(F.col("count") <= most).select("part")
    return q.join(ends.join(few, "part", "left_semi"), "part").select("query_id", "pos", "kmer")


class Unloaded(Exception):
    """A walk needs the neighbours of ``nodes``, which are not there yet."""

    def __init__(self, nodes: set[str]):
        super().__init__()
        self.nodes = nodes


def extend(successors: Callable[[str], list[str]], start: str, query: str, scoring: cg.Scoring, xdrop: int = 27, nodes_per_char: float = 5.0) -> tuple[int, list[tuple[str, int]], str]:
    """Best score, operations and letters of a walk from ``start`` (not included) against a prefix of ``query``.

    Affine gaps, a column of the table for each node of the walks' tree, best columns first;
    columns whose best cell falls xdrop under the best so far are left. The end bonus
    is added at the query's end. Where successors raises Unloaded, the nodes of all columns that are left go with it.
    """
    n, low = len(query), -(10**9)
    if not n:
        return scoring.right_end_bonus, [], ""
    first = [0, *(scoring.gap_open + i * scoring.gap_extend for i in range(n))]
    columns = [(start, -1, "", first, [low] * (n + 1))]
    bonus = lambda j: scoring.right_end_bonus if j == n else 0
    best = max((first[j] + bonus(j), -abs(j), 0, j) for j in range(n + 1) if j in (0, n))
    best = (best[0], 0, best[3])
    heap, made = [(0, 0)], 0
    while heap and made <= nodes_per_char * (n + 1) + 8:
        _, at = heapq.heappop(heap)
        node, _, _, s, d = columns[at]
        try:
            after = successors(node)
        except Unloaded as e:
            raise Unloaded(e.nodes | {columns[i][0] for _, i in heap}) from None
        for nxt in after:
            made += 1
            letter = nxt[-1]
            gap = [max(d[j] + scoring.gap_extend, s[j] + scoring.gap_open) for j in range(n + 1)]
            new, ins = [gap[0]], low
            for j in range(1, n + 1):
                ins = max(ins + scoring.gap_extend, new[j - 1] + scoring.gap_open)
                new.append(max(s[j - 1] + scoring.pair(letter, query[j - 1]), gap[j], ins))
            columns.append((nxt, at, letter, new, gap))
            here = len(columns) - 1
            top = max(range(n + 1), key=lambda j: (new[j] + bonus(j), -j))
            best = max(best, (new[top] + bonus(top), here, top), key=lambda b: (b[0], -b[1]))
            if max(new) >= best[0] - scoring.right_end_bonus - xdrop:
                heapq.heappush(heap, (-max(new), here))
    score, at, j = best
    ops: list[tuple[str, int]] = []
    letters = []
    state = "s"
    while at > 0 or j > 0:
        _, parent, letter, s, d = columns[at]
        if state == "s" and parent >= 0 and j and s[j] == columns[parent][3][j - 1] + scoring.pair(letter, query[j - 1]):
            ops.append(("=" if letter == query[j - 1] else "X", 1))
            letters.append(letter)
            at, j = parent, j - 1
        elif parent >= 0 and (state == "d" or s[j] == d[j]):
            p = columns[parent]
            state = "d" if d[j] == p[4][j] + scoring.gap_extend else "s"
            ops.append(("D", 1))
            letters.append(letter)
            at = parent
        else:
            m = next(m for m in range(1, j + 1) if s[j] == s[j - m] + scoring.gap_open + (m - 1) * scoring.gap_extend)
            ops.append(("I", m))
            j -= m
    return score, ops[::-1], "".join(reversed(letters))


RESULT = "orientation string, sequence string, score int, matches int, cigar string, offset int"


def passed(sequence: str, cigar: str, k: int) -> set[tuple[int, str]]:
    """The query's windows, by place, that the path of an alignment passes as they are."""
    r = q = 0
    out: set[tuple[int, str]] = set()
    for op, n in cg.parse(cigar):
        if op == "=":
            out |= {(q + i, sequence[r + i : r + i + k]) for i in range(n - k + 1)}
        r, q = r + n * (op in "=XD"), q + n * (op in "=XIS")
    return out


#: Up to so many k-mers of labels go to every task whole.
WHOLE = 1 << 17


def ends(nodes: Iterable[str]) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """The nodes by all letters but the last, and by all but the first."""
    by_prefix: dict[str, list[str]] = {}
    by_suffix: dict[str, list[str]] = {}
    for x in nodes:
        by_prefix.setdefault(x[:-1], []).append(x)
        by_suffix.setdefault(x[1:], []).append(x)
    return by_prefix, by_suffix


def align_one(seq: str, nodes: set[str] | tuple[dict[str, list[str]], dict[str, list[str]]], k: int, scoring: cg.Scoring, seeds: list[tuple[int, int]], xdrop: int = 27, done: set[str] | None = None) -> tuple[str, int, int, str] | None:
    """Best (sequence, score, matches, cigar) through any of the seeds (first and last windows).

    A seed that the alignment of an earlier one passes is not extended again.
    nodes: a set, or its ``ends``. done: the nodes whose neighbours are all in ``nodes``, all if not given; raises Unloaded if a walk needs those of others.
    """
    by_prefix, by_suffix = nodes if isinstance(nodes, tuple) else ends(nodes)

    def forward(x: str) -> list[str]:
        if done is not None and x not in done:
            raise Unloaded({x})
        return sorted(by_prefix.get(x[1:], []))

    def backward(x: str) -> list[str]:
        if done is not None and x[::-1] not in done:
            raise Unloaded({x})
        return sorted(y[::-1] for y in by_suffix.get(x[::-1][:-1], []))

    flipped = cg.Scoring(scoring.matrix, scoring.gap_open, scoring.gap_extend, scoring.right_end_bonus, scoring.left_end_bonus, scoring.other)
    best, needed, met = None, set(), set()
    for first, last in seeds:
        if (first, seq[first : first + k]) in met:
            continue
        core = seq[first : last + k]
        walks = []
        for step, start, rest, by in ((forward, core[-k:], seq[last + k :], scoring), (backward, core[:k][::-1], seq[:first][::-1], flipped)):
            try:
                walks.append(extend(step, start, rest, by, xdrop))
            except Unloaded as e:
                needed |= e.nodes if step is forward else {x[::-1] for x in e.nodes}
        if needed:
            continue
        (_, r_ops, r_seq), (_, l_ops, l_seq) = walks
        used_left = sum(n for op, n in l_ops if op != "D")
        used_right = sum(n for op, n in r_ops if op != "D")
        ops = [("S", first - used_left)] * (first > used_left) + l_ops[::-1] + [("=", len(core))] + r_ops + [("S", len(seq) - last - k - used_right)] * (len(seq) - last - k > used_right)
        cigar = cg.show(ops)
        sequence = l_seq[::-1] + core + r_seq
        met |= passed(sequence, cigar, k)
        score = scoring.score(sequence, seq, cigar)
        if best is None or score > best[1]:
            best = (sequence, score, sum(n for op, n in cg.parse(cigar) if op == "="), cigar)
    if needed:
        raise Unloaded(needed - done)
    return best


def align(graph: KmerGraph, queries: DataFrame, scoring: cg.Scoring | None = None, steps: int | None = None, min_match: float = 0.0, xdrop: int = 27, anno: DataFrame | None = None) -> DataFrame:
    """Best alignment of each query (query_id, seq) with a seed.

    Queries of the same letters are aligned once. Rounds of equi-joins gather the nodes near a query's k-mers, then one task extends the query over
    them. Where a walk that is within its drop needs the neighbours of a node that is not passed yet, they
    are gathered and the query is extended anew, so the result is that over the whole graph. With ``steps``,
    only nodes within so many steps are met, and walks end there.

    With ``anno`` (kmer, label) of a graph of basic mode, the best alignment of each query and label with a seed in it: seeds and walks
    keep to the label's nodes, so every k-mer of a path has its label. Where the labels' k-mers are few (``WHOLE``), all go to every task
    and nothing is gathered.
    """
    scoring = scoring or cg.Scoring.of(graph.alphabet.name)
    k = graph.k
    asked = queries.where("query_id IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), graph.alphabet.normalise("seq").alias("seq"))
    # within, query_id is the number of a distinct text
    queries = stored(asked.where("seq IS NOT NULL").select("seq").distinct().select(F.monotonically_increasing_id().alias("query_id"), "seq"), "align-texts")
    windows = explode_kmers(queries, "seq", k, ["query_id"], graph.alphabet)
    everywhere = None
    if anno is None:
        key, extra = ["query_id"], []
        hits, edges = windows.join(graph.both_strands().select("kmer"), "kmer", "left_semi"), graph.edges()
    else:
        if graph.mode != "basic":
            raise ValueError("labels are kept to in graphs of basic mode")
        key, extra = ["query_id", "label"], ["label"]
        has = stored(anno.select("kmer", F.col("label").cast("string").alias("label")).where("label IS NOT NULL").distinct().join(graph.kmers.select("kmer"), "kmer", "left_semi"), "align-labels")
        hits = windows.join(has, "kmer")
        if steps is None and has.count() <= WHOLE:
            of_label: dict[str, list[str]] = {}
            for x in has.collect():
                of_label.setdefault(x.label, []).append(x.kmer)
            everywhere = graph.kmers.sparkSession.sparkContext.broadcast(of_label)
        out, into = (has.select(F.col("kmer").alias(end), "label", F.substring("kmer", at, k - 1).alias("_j")) for end, at in (("source", 2), ("target", 1)))
        edges = out.join(into, ["label", "_j"]).drop("_j")
    runs = _seeds(hits, key, k, min_match)
    texts = queries.withColumnRenamed("seq", "_text")
    answered = lambda found: asked.join(found.join(texts, "query_id").drop("query_id"), F.col("seq") == F.col("_text")).drop("seq", "_text")
    if everywhere is not None:

        def run_whole(frames):
            met = {}
            for f in frames:
                out = []
                for i, label, seq, seeds in zip(f["query_id"], f["label"], f["seq"], f["seeds"], strict=True):
                    if label not in met:
                        met[label] = ends(everywhere.value[label])
                    sequence, score, matches, cigar = align_one(seq, met[label], k, scoring, sorted((int(x["first"]), int(x["last"])) for x in seeds), xdrop)
                    out.append((i, label, "+", sequence, score, matches, cigar, 0))
                yield pd.DataFrame(out, columns=["query_id", "label", "orientation", "sequence", "score", "matches", "cigar", "offset"])

        pairs = queries.join(runs.groupBy(*key).agg(F.collect_list(F.struct("first", "last")).alias("seeds")), "query_id").select(*key, "seq", "seeds")
        dealt = pairs.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism, *key)
        return answered(stored(dealt.mapInPandas(run_whole, f"query_id long, label string, {RESULT}"), "align-found"))
    edges = stored(edges.select("source", "target", *extra), "align-edges")
    ahead, behind = edges.withColumnRenamed("source", "kmer"), edges.withColumnRenamed("target", "kmer")

    def gathered(front: DataFrame, near: DataFrame, done: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
        """near and done (key, kmer) after up to most steps from front."""
        for _ in range(most):
            new = front.join(ahead, ["kmer", *extra]).select(*key, F.col("target").alias("kmer")).unionByName(front.join(behind, ["kmer", *extra]).select(*key, F.col("source").alias("kmer"))).distinct().join(near, [*key, "kmer"], "left_anti")
            done = stored(done.unionByName(front), "align-done")
            front = stored(new, "align-front")
            if front.isEmpty():
                break
            near = stored(near.unionByName(front), "align-near")
        return near, done

    def run(frames):
        for f in frames:
            out = []
            for *who, seq, seeds, nodes, passed_ in zip(*(f[c] for c in (*key, "seq", "seeds", "nodes", "passed")), strict=True):
                places = sorted((int(x["first"]), int(x["last"])) for x in seeds)
                try:
                    if found := align_one(seq, set(nodes), k, scoring, places, xdrop, None if steps is not None else set(passed_) if passed_ is not None else set()):
                        out.append((*who, "+", found[0], found[1], found[2], found[3], 0, []))
                except Unloaded as e:
                    out.append((*who, "+", None, 0, 0, None, 0, sorted(e.nodes)))
            yield pd.DataFrame(out, columns=[*key, "orientation", "sequence", "score", "matches", "cigar", "offset", "needed"])

    schema = f"query_id long, {'label string, ' * bool(extra)}{RESULT}, needed array<string>"
    every = stored(queries.join(runs.groupBy(*key).agg(F.collect_list(F.struct("first", "last")).alias("seeds")), "query_id").withColumn("whole", F.exists("seeds", lambda s: (s["first"] == 0) & (s["last"] == F.char_length("seq") - k))), "align-queries")
    # a seed that is all of the query has nothing to extend, so no nodes are gathered for it
    alone = every.where("whole").select(*key, "seq", "seeds", F.array().cast("array<string>").alias("nodes"), F.lit(None).cast("array<string>").alias("passed"))
    left = every.where("NOT whole").drop("whole")
    near = stored(hits.join(left.select(*key), key, "left_semi").select(*key, "kmer").distinct(), "align-near")
    near, done = gathered(near, near, near.limit(0), k + 1 if steps is None else steps)
    found = alone.mapInPandas(run, schema).drop("needed")
    while True:
        groups = left.join(near.groupBy(*key).agg(F.collect_list("kmer").alias("nodes")), key).join(done.groupBy(*key).agg(F.collect_list("kmer").alias("passed")), key, "left")
        tried = stored(groups.select(*key, "seq", "seeds", "nodes", "passed").mapInPandas(run, schema), "align-tried")
        ended = tried.where("size(needed) = 0").drop("needed")
        found = found.unionByName(ended)
        needed = tried.select(*key, F.explode("needed").alias("kmer"))
        if needed.isEmpty():
            return answered(found)
        left = stored(left.join(needed.select(*key).distinct(), key, "left_semi"), "align-queries")
        near, done = gathered(needed, near.join(left, key, "left_semi"), done.join(left, key, "left_semi"), k + 1)


def align_both_strands(graph: KmerGraph, queries: DataFrame, **options) -> DataFrame:
    """The better of the query and its reverse complement (orientation -), forward first on ties; of each label if labels are kept to."""
    plus = align(graph, queries, **options)
    minus = align(graph, queries.select("query_id", graph.alphabet.reverse_complement(graph.alphabet.normalise("seq")).alias("seq")), **options).withColumn("orientation", F.lit("-"))
    key = [c for c in ("query_id", "label") if c in plus.columns]
    best = Window.partitionBy(*key).orderBy(F.col("score").desc(), "orientation")
    return plus.unionByName(minus).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def chain(seeds: DataFrame, min_seed_length: int = 19, bandwidth: int = 65) -> DataFrame:
    """query_id, label, score and chain: the best colinear chain of seeds (query_id, label, pos, coord, length, and query_length).

    A seed adds its letters before the next one's start, by query and by label; where the two distances differ by
    d, 0.01 * min_seed_length * d + 0.5 * log2(d + 1) is charged. Neighbours in a chain are less than a query
    apart and at most ``bandwidth`` seeds from each other, by coordinate.
    """

    def best(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["coord", "pos"], ascending=False)
        p, c, n = (f[x].to_numpy(np.int64) for x in ("pos", "coord", "length"))
        size = int(f["query_length"].iloc[0])
        score, after = n.astype(float), np.full(len(p), -1)
        for i in range(len(p)):
            j = slice(max(0, i - bandwidth + 1), i)
            dq, dc = p[j] - p[i], c[j] - c[i]
            d = np.abs(dq - dc)
            s = score[j] + np.minimum(np.minimum(dq, dc), n[i]) - 0.01 * min_seed_length * d - 0.5 * np.log2(d + 1)
            s[(dq <= 0) | (np.maximum(dq, dc) >= size)] = -np.inf
            if len(s) and s.max() > score[i]:
                after[i] = j.start + int(s.argmax())
                score[i] = s.max()
        i = int(score.argmax())
        total, members = float(score[i]), []
        while i >= 0:
            members.append(f"{p[i]}@{c[i]}+{n[i]}")
            i = int(after[i])
        return pd.DataFrame([(key[0], key[1], total, ",".join(members))], columns=["query_id", "label", "score", "chain"])

    return seeds.groupBy("query_id", "label").applyInPandas(best, "query_id long, label string, score double, chain string")


def labelled(alignments: DataFrame, anno: DataFrame, graph: KmerGraph) -> DataFrame:
    """alignments with the labels that hold every k-mer of their path."""
    path = explode_kmers(alignments.select("query_id", "sequence"), "sequence", graph.k, ["query_id"], graph.alphabet)
    kept = path.join(anno, "kmer").groupBy("query_id", "label").agg(F.count("*").alias("n"), F.max("n_kmers").alias("all")).where("n = all")
    return alignments.join(kept.groupBy("query_id").agg(F.sort_array(F.collect_list("label")).alias("labels")), "query_id", "left")


def top(alignments: DataFrame, n: int = 1, cutoff: float = 0.95) -> DataFrame:
    """The best n of each query, or of each of its labels if there is a column ``label``, within a share of the query's best score: by score, forward first."""
    best = Window.partitionBy("query_id")
    key = [c for c in ("query_id", "label") if c in alignments.columns]
    order = Window.partitionBy(*key).orderBy(F.col("score").desc(), "orientation", "sequence")
    ranked = alignments.withColumn("_b", F.max("score").over(best)).withColumn("_r", F.row_number().over(order))
    return ranked.where((F.col("_r") <= n) & (F.col("score") >= F.col("_b") * cutoff)).drop("_b", "_r")


def valid(seq: str, sequence: str, cigar: str, k: int, nodes: set[str]) -> bool:
    """Whether the path is in the graph and the operations lead from it to the query."""
    return cg.is_valid(cg.parse(cigar), sequence, seq) and all(sequence[i : i + k] in nodes for i in range(len(sequence) - k + 1))


def as_tsv(alignments: DataFrame) -> DataFrame:
    return alignments.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("query_id", "orientation", "sequence", "score", "matches", "cigar", "offset")]).alias("line"))
