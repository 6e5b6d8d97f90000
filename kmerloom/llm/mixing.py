"""Mixing sources to target weights by a low-discrepancy schedule.

Slot t of the mix goes to the source in whose share of the cumulative targets the
golden-ratio point frac((t + 1) * phi) falls. Slots are ranked by source; a
source's documents, in hash order and repeated up to ``most_repeats`` times,
form a stream that is cut into blocks of BLOCK words; the slot of rank r takes block r.
A source needs as many blocks as its target fills, the last of them in part. The
schedule goes on, in rounds over the shares that are still missing, until every source
has that many slots, so what the mix takes is what its slots cover.

Defined cases: null text has size 0; a null source comes last; documents of
size 0 take nothing; equal rows are documents of their own, and which of them takes what is
open; an empty table gives an empty result. Sources are few: the driver holds a row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import placed, row_ids, stored, taken, text_of

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
#: Words of a block.
BLOCK = 1024
#: Slots that one task schedules, and rows of a source whose running sizes are summed together.
CHUNK = 1 << 16
STREAM_ROWS = 8192
PHI = 0x9E3779B97F4A7C15
_SHUFFLE_SEED = 17


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> list[float]:
    """Targets of sources with these sizes: shares by weight, none above most times its size; they sum to all sizes."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total, capped = float(sum(sizes)), set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        free = sum(w[i] for i in range(len(sizes)) if i not in capped)
        share = [float(most * sizes[i]) if i in capped else left * w[i] / free for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in capped and share[i] > most * sizes[i]}
        if not over:
            return share
        capped |= over


def _slots(t: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Source of each slot; ends: upper ends of the sources' shares, of 2**64."""
    with np.errstate(over="ignore"):
        points = (t.astype(np.uint64) + np.uint64(1)) * np.uint64(PHI)
    return np.searchsorted(ends, points, side="left").astype(np.int64)


def _ends(shares: list[float]) -> np.ndarray:
    total = sum(shares) or 1.0
    ends = np.array([min(2**64 - 1, int(x / total * 2**64)) for x in np.cumsum(shares)], np.uint64)
    if len(ends):
        ends[max(i for i, x in enumerate(shares) if x or not i) :] = np.uint64(2**64 - 1)
    return ends


def _counted(ends: np.ndarray, slots: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b["id"].to_pylist():
                n = np.bincount(_slots(np.arange(c * chunk, min(slots, (c + 1) * chunk)), ends), minlength=len(ends))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c)), pa.array(at), pa.array(n[at])], ["chunk", "src", "n"])

    return run


def _ranked(ends: np.ndarray, slots: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, before in zip(b["chunk"].to_pylist(), b["before"].to_pylist(), strict=True):
                t = np.arange(c * chunk, min(slots, (c + 1) * chunk))
                src = _slots(t, ends)
                first = np.zeros(len(ends), np.int64)
                for x in before:
                    first[x["src"]] = x["rank"]
                order = np.argsort(src, kind="stable")
                s = src[order]
                inside = np.arange(len(s)) - np.searchsorted(s, s)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(first[s] + inside), pa.array(t[order])], ["src", "block", "slot"])

    return run


def counted(spark, shares: list[float], slots: int, chunk: int = CHUNK) -> np.ndarray:
    """How many of the slots each source gets; many slots are counted by tasks."""
    ends = _ends(shares)
    if slots <= chunk:
        return np.bincount(_slots(np.arange(slots), ends), minlength=len(ends))
    out = np.zeros(len(ends), np.int64)
    for x in spark.range(-(-slots // chunk)).mapInArrow(_counted(ends, slots, chunk), "chunk long, src long, n long").groupBy("src").agg(F.sum("n").alias("n")).collect():
        out[x.src] = x.n
    return out


def rounds(spark, needed: list[int], chunk: int = CHUNK) -> list[tuple[list[int], int, list[int]]]:
    """(shares, first slot, slots each source had before) of each round, until each source has the slots that it needs."""
    left, before, at, out = np.array(needed, np.int64), np.zeros(len(needed), np.int64), 0, []
    while left.sum():
        shares = left.tolist()
        out.append((shares, at, before.tolist()))
        got = counted(spark, shares, sum(shares), chunk)
        before, left, at = before + got, np.maximum(left - got, 0), at + sum(shares)
    return out


def schedule(spark, shares: list[float], slots: int, chunk: int = CHUNK) -> DataFrame:
    """src, block (rank of the slot in its source), slot, for all slots."""
    ends, chunks = _ends(shares), -(-slots // chunk)
    counts = spark.range(chunks).mapInArrow(_counted(ends, slots, chunk), "chunk long, src long, n long")
    before = counts.selectExpr("chunk", "src", "sum(n) OVER (PARTITION BY src ORDER BY chunk) - n AS rank")
    return before.groupBy("chunk").agg(F.collect_list(F.struct("src", "rank")).alias("before")).mapInArrow(_ranked(ends, slots, chunk), "src long, block long, slot long")


def complete_schedule(spark, needed: list[int], chunk: int = CHUNK) -> DataFrame:
    """src, block, slot: as many slots as each source needs, and where a round gave it more, those too."""
    out = None
    for shares, first, before in rounds(spark, needed, chunk):
        passed = F.element_at(F.array(*map(F.lit, before)).cast("array<long>"), (F.col("src") + 1).cast("int")) if any(before) else F.lit(0).cast("long")
        part = schedule(spark, shares, sum(shares), chunk).select("src", (F.col("block") + passed).alias("block"), (F.col("slot") + first).alias("slot"))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "src long, block long, slot long") if out is None else out


def sized(docs: DataFrame) -> DataFrame:
    """uid, doc_id, source, size, h (place in the source's hash order), and at if docs has it; stored."""
    text = text_of("text")
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return stored(row_ids(docs.select(*["at"] * ("at" in docs.columns), F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), F.xxhash64(F.lit(_SHUFFLE_SEED), "doc_id", F.xxhash64(text)).alias("h"))), "sized")


def _streams(rows: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """uid, src, size, source_size, take and place of each row that has words: where it begins in its source's stream.

    The stream is cut into ranges of about STREAM_ROWS rows, by as many leading bits of h as the source's
    rows need. Where equal rows, which share h, make a range longer, they come after its others, dealt to ranges by their numbers.
    """
    known = rows.where("size > 0").join(F.broadcast(sources), rows.source.eqNullSafe(sources.source)).select("uid", "src", "size", "h", "doc_id", "source_size", "take", F.expr("CASE WHEN cut = 0 THEN 0L ELSE shiftright(h, 64 - cut) END").alias("part"))
    lengths = stored(known.groupBy("src", "part").agg(F.count("*").alias("m")).where(F.col("m") > 4 * STREAM_ROWS), "long-ranges")
    alike, salt = F.lit(None).cast("long"), F.lit(0).cast("long")
    if not lengths.isEmpty():
        equal = known.join(lengths, ["src", "part"], "left_semi").groupBy("src", "h").agg(F.count("*").alias("m")).where(F.col("m") > STREAM_ROWS)
        known = known.join(F.broadcast(equal), ["src", "h"], "left")  # fewer than a row in STREAM_ROWS
        alike, salt = F.when(F.col("m").isNotNull(), F.col("h")), F.coalesce(F.pmod(F.xxhash64("uid"), F.ceil(F.col("m") / STREAM_ROWS)), F.lit(0).cast("long"))
    known = known.select("uid", "src", "size", "h", "doc_id", "source_size", "take", F.struct("part", alike.alias("alike"), salt.alias("salt")).alias("range"))
    ranges = known.groupBy("src", "range").agg(F.sum("size").alias("n")).selectExpr("src", "range", "sum(n) OVER (PARTITION BY src ORDER BY range) - n AS before")
    return known.join(ranges, ["src", "range"]).selectExpr("uid", "src", "size", "source_size", "take", "before + sum(size) OVER (PARTITION BY src, range ORDER BY h, doc_id, size, uid ROWS UNBOUNDED PRECEDING) - size AS place")


def mixed(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, most: int = MOST_REPEATS) -> tuple[DataFrame, DataFrame]:
    """The sources (src, source, source_size, target, take, cut) and the mix: slot, src, block, uid, epoch, start and length of each piece."""
    spark = rows.sparkSession
    found = sorted(((x.source, x.n or 0, x.m) for x in rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("m")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n, _ in found]
    shares = targets(sizes, weights, most)
    takes = [min(most * n, round(x)) for n, x in zip(sizes, shares, strict=True)]
    schema = T.StructType([T.StructField("src", T.LongType()), T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("take", T.LongType()), T.StructField("cut", T.IntegerType())])
    cuts = [max(0, min(40, math.ceil(math.log2(max(1, m / STREAM_ROWS))))) for _, _, m in found]
    sources = spark.createDataFrame([(i, s, n, x, k, c) for i, ((s, n, _), x, k, c) in enumerate(zip(found, shares, takes, cuts, strict=True))], schema)
    placed_ = _streams(rows, sources, most)
    epochs = placed_.select("*", F.posexplode(F.array_repeat(F.lit(0), most)).alias("epoch", "_")).selectExpr("uid", "src", "epoch", "epoch * source_size + place AS lo", "least(epoch * source_size + place + size, take) AS hi").where("hi > lo")
    blocks = epochs.select("*", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))).alias("block"))
    cutout = blocks.selectExpr("src", "block", "uid", "epoch", f"greatest(lo, block * {block}) - lo AS start", f"least(hi, (block + 1) * {block}) - greatest(lo, block * {block}) AS length")
    slots = complete_schedule(spark, [-(-k // block) for k in takes])
    return sources, cutout.join(slots.hint("merge"), ["src", "block"]).select("slot", "src", "block", "uid", "epoch", "start", "length")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """uid, doc_id, source, size, source_size, target, taken and first_slot (null where nothing is taken) for each row of docs."""
    rows = sized(docs)
    sources, manifest = mixed(rows, weights, block)
    taken_ = manifest.groupBy("uid").agg(F.sum("length").alias("taken"), F.min("slot").alias("first_slot"))
    known = rows.join(F.broadcast(sources), rows.source.eqNullSafe(sources.source)).select("uid", "doc_id", rows.source, "size", "source_size", "target")
    return known.join(taken_, "uid", "left").select(*known.columns, F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_slot")


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """The rows of docs, with their columns, each as often as the mix's slots take its words, to the nearest whole number.

    A document is taken in whole passes, but for the one at the end of its source's stream.
    """
    docs, located = placed(docs, "doc_id", "source", "text")
    rows = sized(located)
    _, manifest = mixed(rows, weights, block)
    words = manifest.groupBy("uid").agg(F.sum("length").alias("taken"))
    return taken(docs, rows.select("uid", "at", "size").join(words, "uid").select("at", F.round(F.col("taken") / F.col("size")).cast("int").alias("n")))
