"""Exact dedup by a minimal perfect hash over historical distinct digests.

The distinct digests of a history are cut into shards by hash. Each shard gets
a minimal perfect hash (levels of bitmaps; a digest's slot is the rank of its
bit) whose slots hold the full 32-byte digest and the winner's locator. A
document's digest is looked up in its shard: the slot's digest is compared byte
by byte, so a hit is certain; nonmembers are grouped separately.

Defined cases: null text is empty text; of equal texts the one with the most
code points, then the smallest doc_id (null ids last), then the first stored
row stays; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, placed, row_ids, stored, taken, text_of

#: Distinct digests that one shard is meant to hold, and rows looked up in one task's group.
SHARD_DIGESTS = 4096
PROBE_ROWS = 8192
#: Bits of a level for each digest that is still without a slot.
GAMMA = 1.6
MAX_LEVELS = 64
INDEX_SCHEMA = "shard long, n long, bitmaps binary, sizes array<long>, rest binary, slots binary, keep_id array<long>, keep_uid array<long>, group_size array<long>"


def normalised(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def build_mphf(digests: np.ndarray) -> tuple[list[np.ndarray], list[int], np.ndarray, np.ndarray]:
    """digests: (n, 32) bytes, distinct. Bitmaps and sizes of the levels, digests left over, slot of each digest.

    Level by level, a digest that alone hits a bit takes it; the others go on. The
    few that never do (only if their keys agree) take the slots after all bits.
    """
    keys = digests.view(np.uint64)[:, 0] ^ digests.view(np.uint64)[:, 2] if len(digests) else np.zeros(0, np.uint64)
    left, slots = np.arange(len(digests)), np.full(len(digests), -1, np.int64)
    bitmaps, sizes, base = [], [], 0
    while len(left) and len(bitmaps) < MAX_LEVELS:
        size = max(64, math.ceil(GAMMA * len(left)))
        at = (_mix(keys[left], len(bitmaps)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        won = alone[at]
        slots[left[won]] = base + (np.cumsum(alone) - 1)[at[won]]
        base += int(alone.sum())
        bitmaps.append(np.packbits(alone))
        sizes.append(size)
        left = left[~won]
    slots[left] = base + np.arange(len(left))
    return bitmaps, sizes, digests[left], slots


class Shard:
    """One shard of the index, ready for lookups."""

    def __init__(self, bitmaps: bytes, sizes: list[int], rest: bytes, slots: bytes):
        self.levels, at, base = [], 0, 0
        for size in sizes:
            n = (size + 7) // 8
            bits = np.unpackbits(np.frombuffer(bitmaps, np.uint8, n, at), count=size).astype(bool)
            self.levels.append((bits, base + np.cumsum(bits) - 1))
            base += int(bits.sum())
            at += n
        self.rest = {rest[i : i + 32]: base + i // 32 for i in range(0, len(rest), 32)}
        self.slots = np.frombuffer(slots, np.uint8).reshape(-1, 32)

    def lookup(self, digests: np.ndarray) -> np.ndarray:
        """Slot of each digest, -1 for nonmembers; every hit is checked against the slot's bytes."""
        keys = digests.view(np.uint64)[:, 0] ^ digests.view(np.uint64)[:, 2] if len(digests) else np.zeros(0, np.uint64)
        out, left = np.full(len(digests), -1, np.int64), np.arange(len(digests))
        for level, (bits, ranks) in enumerate(self.levels):
            at = (_mix(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        for i in left if self.rest else ():
            out[i] = self.rest.get(digests[i].tobytes(), -1)
        if (found := np.flatnonzero(out >= 0)).size:
            out[found[(self.slots[out[found]] != digests[found]).any(axis=1)]] = -1
        return out


def _bytes_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _build(table: pa.Table) -> pa.Table:
    digests = _bytes_of(table["digest"])
    bitmaps, sizes, rest, slots = build_mphf(digests)
    order = np.argsort(slots)
    table = table.take(pa.array(order))
    row = {
        "shard": table["shard"][0].as_py(), "n": len(order), "bitmaps": b"".join(x.tobytes() for x in bitmaps), "sizes": sizes,
        "rest": rest.tobytes(), "slots": digests[order].tobytes(), "keep_id": table["keep_id"].to_pylist(), "keep_uid": table["keep_uid"].to_pylist(), "group_size": table["group_size"].to_pylist(),
    }
    return pa.Table.from_pylist([row], schema=_INDEX_ARROW)


_INDEX_ARROW = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("bitmaps", pa.binary()), ("sizes", pa.list_(pa.int64())), ("rest", pa.binary()), ("slots", pa.binary()), ("keep_id", pa.list_(pa.int64())), ("keep_uid", pa.list_(pa.int64())), ("group_size", pa.list_(pa.int64()))])
_FOUND = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("n_chars", pa.int64()), ("keep_id", pa.int64()), ("keep_uid", pa.int64()), ("group_size", pa.int64())])
_FOUND_DDL = "uid long, doc_id long, digest binary, n_chars long, keep_id long, keep_uid long, group_size long"


def _probe(rows: pa.Table, index: pa.Table) -> pa.Table:
    if not len(rows):
        return pa.Table.from_pylist([], schema=_FOUND)
    out = {k: rows[k] for k in ("uid", "doc_id", "digest", "n_chars")}
    if not len(index):
        none = pa.nulls(len(rows), pa.int64())
        return pa.table(out | {"keep_id": none, "keep_uid": none, "group_size": none}).cast(_FOUND)
    x = {k: index[k][0].as_py() for k in ("bitmaps", "sizes", "rest", "slots", "keep_id", "keep_uid", "group_size")}
    at = Shard(x["bitmaps"], x["sizes"], x["rest"], x["slots"]).lookup(_bytes_of(rows["digest"]))
    take = pa.array(at, mask=at < 0)
    return pa.table(out | {k: pa.array(x[k], pa.int64()).take(take) for k in ("keep_id", "keep_uid", "group_size")}).cast(_FOUND)


def digests(docs: DataFrame) -> DataFrame:
    """uid, doc_id, digest (sha256 of the text without white space), n_chars (of the text as it is), and at if docs has it; stored."""
    text = text_of("text")
    out = docs.select(*["at"] * ("at" in docs.columns), F.col("doc_id").cast("long"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"), F.char_length(text).cast("long").alias("n_chars"))
    return stored(row_ids(out), "digests")


def winners(rows: DataFrame) -> DataFrame:
    """digest, keep_id, keep_uid, group_size; partial sums before the shuffle, so large groups shrink first."""
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("z"), "doc_id", "uid"))
    return rows.groupBy("digest").agg(best.alias("b"), F.count("*").alias("group_size")).select("digest", F.col("b.doc_id").alias("keep_id"), F.col("b.uid").alias("keep_uid"), "group_size")


def _shard(n_shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n_shards)).alias("shard")


def build_index(history: DataFrame, n_shards: int) -> DataFrame:
    """history: rows of ``winners``. One row for each shard; store it to use it in later runs."""
    return history.select(_shard(n_shards), "*").groupBy("shard").applyInArrow(_build, INDEX_SCHEMA)


def lookup(rows: DataFrame, index: DataFrame, n_shards: int) -> DataFrame:
    """rows with keep_id, keep_uid and group_size of their digest's slot, null where it is no member.

    A shard that many of the rows ask for is met by as many salted groups, each with its own copy of the
    shard, so no copy group lands in one task; a shard that no row asks for is not moved.
    """
    dealt = rows.select("*", _shard(n_shards))
    salts = stored(dealt.groupBy("shard").agg(F.ceil(F.count("*") / PROBE_ROWS).alias("salts")), "salts")
    dealt = dealt.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("uid"), "salts")).drop("salts")
    copies = index.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return dealt.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(_probe, _FOUND_DDL)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """uid, doc_id, digest, n_chars, keep_id, keep_uid, group_size, kept: a row for each row of docs.

    history: what ``winners`` gave for earlier documents; None takes docs itself as
    its history. With a history, a member's winner is the historical one
    and its group_size counts the historical rows only.
    """
    return _deduplicated(digests(docs), history)


def _deduplicated(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    n_shards = max(1, math.ceil((rows if history is None else history).count() / SHARD_DIGESTS))
    index = stored(build_index(winners(rows) if history is None else history, n_shards), "mphf")
    found = stored(lookup(rows, index, n_shards), "found")
    strangers = found.where("group_size IS NULL").drop("keep_id", "keep_uid", "group_size")
    groups = winners(strangers)
    alone = strangers.join(groups, "digest").select(found.columns)
    own = F.lit(history is None) | F.col("new")
    return found.where("group_size IS NOT NULL").withColumn("new", F.lit(False)).unionByName(alone.withColumn("new", F.lit(True))).withColumn("kept", own & (F.col("uid") == F.col("keep_uid"))).drop("new")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, that stay."""
    docs, located = placed(docs, "doc_id", "text")
    rows = digests(located)
    kept = _deduplicated(rows.drop("at")).where("kept").select("uid")
    return taken(docs, rows.join(kept, "uid").select("at", F.lit(1).alias("n")))
