"""SimHash near-dedup by tiled exact comparison.

Each text gets 64 bits from the hashes of its word shingles. Distinct
fingerprints at most ``radius`` bits apart agree in at least blocks - radius of
the 64 bits' ``blocks`` blocks, so those that share such a band, a choice of blocks - radius
blocks, are compared, exactly, in tiles: numpy
exclusive-or and bit counts over tiles sorted by population count, where a
pair of tiles whose counts differ by more than the radius is skipped. More blocks
make more bands, each with more bits, so fewer fingerprints meet by chance;
their number follows the number of distinct fingerprints and never changes a link. A band
value with many fingerprints is cut into tiles by population count and hash,
and each pair of tiles is a unit of work of its own. A unit returns links that span
its components, not all pairs; components of the whole come from repeated
large-star and small-star steps, each stored.

Defined cases: null and wordless texts have fingerprint zero and are linked like
any other; fewer words than a shingle make one shingle; rows that repeat
share a component; a component of null ids only has a null id; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import dropped
from .common import placed, row_ids, slices, stored, taken, words

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints of a band value that are compared as one unit of work; more are cut into tiles of this size.
TILE = 4096
#: Rows and columns of the matrices in which a unit is compared.
STEP = 512
#: Comparisons that cost as much as one row of one band.
ROW = 2000


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    ws = words(text)
    if not ws:
        return 0
    whole = b" ".join(ws)
    if len(ws) <= n:
        hashes = xxhash.xxh64_digest(whole, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(whole[a:b], SEED) for a, b in zip(starts[: len(ws) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(rows)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        fps = np.array([fingerprint(x) for x in b["text"].to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps)], [*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """uid, doc_id, fp (the 64 bits as a signed long), and at if docs has it; stored."""
    at = "at" in docs.columns
    source = docs.select(*["at"] * at, F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = source.mapInArrow(_fingerprints, "at struct<file:string,row:long>, " * at + "doc_id long, fp long")
    return stored(row_ids(out), "simhash")


def near(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a and b (each sorted by population count) at most radius bits apart, tile pair by tile pair."""
    pa_, pb = np.bitwise_count(a), np.bitwise_count(b)
    for i in range(0, len(a), STEP):
        x, low, high = a[i : i + STEP], int(pa_[i]) - radius, int(pa_[min(i + STEP, len(a)) - 1]) + radius
        for j in range(0, len(b), STEP):
            if int(pb[j]) > high:
                break
            if int(pb[min(j + STEP, len(b)) - 1]) < low:
                continue
            hits = np.nonzero(np.bitwise_count(x[:, None] ^ b[None, j : j + STEP]) <= radius)
            if len(hits[0]):
                yield hits[0] + i, hits[1] + j


def _merged(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after linking i with j: smallest index of each component."""
    i, j = labels[i], labels[j]
    keep = i != j
    i, j = i[keep], j[keep]
    while len(i):
        low = np.minimum(i, j)
        np.minimum.at(labels, i, low)
        np.minimum.at(labels, j, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]
        i, j = labels[i], labels[j]
        keep = i != j
        i, j = i[keep], j[keep]
    return labels


def spanning(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components among a (b None) or between a and b."""
    a = a[np.argsort(np.bitwise_count(a), kind="stable")]
    if b is None:
        every, off, b = a, 0, a
    else:
        b = b[np.argsort(np.bitwise_count(b), kind="stable")]
        every, off = np.concatenate((a, b)), len(a)
    labels = np.arange(len(every))
    for i, j in near(a, b, radius):
        labels = _merged(labels, i, j + off)
    linked = np.flatnonzero(labels != np.arange(len(every)))
    return every[linked], every[labels[linked]]


def _compared(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit; side 1 is set for the second tile of a pair."""
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            unit, side, fp = (b[k].to_numpy(zero_copy_only=False) for k in ("unit", "side", "fp"))
            cuts = [0, *(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(unit)]
            out = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if kept and hi > lo and kept[0][0][0] != unit[lo]:
                    out.append(_unit(kept, radius))
                    kept = []
                if hi > lo:
                    kept.append((unit[lo:hi], side[lo:hi], fp[lo:hi]))
            yield from _links(out)
        if kept:
            yield from _links([_unit(kept, radius)])

    return run


def _unit(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    side, fp = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    fp = fp.view(np.uint64)
    return spanning(fp[side == 0], fp[side == 1] if side.any() else None, radius) if len(fp) > 1 else (fp[:0], fp[:0])


def _links(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if any(len(x) for x, _ in found):
        a, b = (np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])


def bands(radius: int, blocks: int) -> list[int]:
    """The bits of each choice of blocks - radius of the blocks, as signed longs: fingerprints within the radius agree in all bits of one."""
    edges = [64 * j // blocks for j in range(blocks + 1)]
    block = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [x - (1 << 64) if x >> 63 else x for x in (sum(c) for c in combinations(block, blocks - radius))]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """The number of blocks with the least work for n distinct fingerprints: rows of all bands, and comparisons by chance."""
    return min(range(radius + 1, min(2 * radius + 1, 64) + 1), key=lambda b: comb(b, radius) * (ROW + n / 2 ** (64 * (b - radius) / b + 1)))


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """u, v (u > v): links that span the components of the distinct fingerprints in column fp, the same for any number of blocks."""
    blocks = blocks or blocks_for(distinct.count(), radius)
    edges = F.array(*[F.xxhash64(F.lit(j), F.col("fp").bitwiseAND(F.lit(x))) for j, x in enumerate(bands(radius, blocks))])
    rows = distinct.select("fp", F.explode(edges).alias("bucket")).select("fp", "bucket", F.bit_count("fp").alias("ones"))
    hot = stored(rows.groupBy("bucket", "ones").count().withColumn("m", F.expr("sum(count) OVER (PARTITION BY bucket)")).where(F.col("m") > tile).select("bucket", "ones", F.ceil(F.col("count") / tile).alias("salts")), "hot-bands")
    plain = rows.join(hot.select("bucket").distinct(), "bucket", "left_anti").select(F.col("bucket").alias("unit"), F.lit(0).alias("side"), "fp")
    tiles = hot.select("bucket", "ones", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    x, y = (tiles.select("bucket", F.col("ones").alias(f"ones{s}"), F.col("salt").alias(f"salt{s}")) for s in "ab")
    pairs = x.join(y, "bucket").where("onesb - onesa BETWEEN 0 AND {r} AND (onesb > onesa OR saltb >= salta)".format(r=radius)).withColumn("unit", F.xxhash64("bucket", "onesa", "salta", "onesb", "saltb"))
    first = pairs.select("bucket", F.col("onesa").alias("ones"), F.col("salta").alias("salt"), "unit", F.lit(0).alias("side"))
    second = pairs.where("onesa <> onesb OR salta <> saltb").select("bucket", F.col("onesb").alias("ones"), F.col("saltb").alias("salt"), "unit", F.lit(1).alias("side"))
    salted = rows.join(hot, ["bucket", "ones"]).withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")))
    tiled = salted.join(first.unionByName(second), ["bucket", "ones", "salt"]).select("unit", "side", "fp")
    units = plain.unionByName(tiled) if hot.limit(1).count() else plain
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(_compared(radius), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) for each node with an edge; edges: u > v."""
    edges = stored(edges, "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        after = stored(small, "stars")
        dropped(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """uid, doc_id, fp, component_id and kept (true for the component's first row by doc_id, nulls last)."""
    return _classified(fingerprints(docs), radius)


def _classified(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "uid")).alias("first")
    distinct = stored(rows.groupBy("fp").agg(first), "distinct")
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    classes = stored(rooted.join(best, "root").select("fp", F.col("best.doc_id").alias("component_id"), F.col("best.uid").alias("keep_uid")), "classes")
    return rows.join(classes, "fp").select("uid", "doc_id", "fp", "component_id", (F.col("uid") == F.col("keep_uid")).alias("kept"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, that stay: one of each component."""
    docs, located = placed(docs, "doc_id", "text")
    rows = fingerprints(located)
    kept = _classified(rows.drop("at")).where("kept").select("uid")
    return taken(docs, rows.join(kept, "uid").select("at", F.lit(1).alias("n")))
