"""Token ids in directly addressable codes.

A segment is a self-contained block of bytes with whole documents, in ascending
doc_id order. Its ids are split into 8-bit chunks: level 0 has each id's low
chunk, level j + 1 the next chunk of those ids that have one, and a bitmap a
level tells which ids go on; a rank directory (ones before each 512-bit block)
gives the place in the next level. So any id is read from a few bytes
of each level, without decoding its neighbours.

Segments are rows of a Parquet table (shard, segment, before, n_tokens, payload),
which any store that Spark writes to can hold; shards are ranges of doc_id.

Defined cases: null text is empty and gives the end id alone; null doc_ids come
first; repeated rows are written each (order among equal doc_ids: by
text); an empty table gives no segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import scratch_path
from .common import slices
from .tokens import Encoder

END_ID = 0
#: A segment is closed at the first document that takes it to so many ids.
SEGMENT_IDS = 1 << 20
BLOCK = 512
#: Bytes of text a shard is meant to hold.
SHARD_BYTES = 16 << 20
MAGIC = b"DAC1"
_HEAD = "<4sIQQ"  # magic, levels, documents, ids
_LEVEL = "<QQ"  # chunks, whether a bitmap follows
SEGMENTS = "shard int, segment int, before long, n_tokens long, payload binary"


def encode(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A segment's bytes: header, doc_ids with null flags, document ends, levels."""
    levels, now = [], ids.astype(np.uint32)
    while True:
        more = now > 255
        levels.append(((now & 255).astype(np.uint8), more))
        if not more.any():
            break
        now = now[more] >> np.uint32(8)
    out = [struct.pack(_HEAD, MAGIC, len(levels), len(doc_ids), len(ids))]
    out.append(np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes())
    out.append(np.packbits(np.array([x is None for x in doc_ids], bool), bitorder="little").tobytes())
    out.append(np.cumsum(np.array(lengths, "<u8"), dtype="<u8").tobytes())
    for k, (chunks, more) in enumerate(levels):
        last = k == len(levels) - 1
        out.append(struct.pack(_LEVEL, len(chunks), 0 if last else 1))
        if not last:
            bits = np.packbits(more, bitorder="little")
            ones = np.bitwise_count(np.pad(bits, (0, -len(bits) % (BLOCK // 8))).reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint64)
            ranks = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4")
            out += [bits.tobytes(), ranks.tobytes()]
        out.append(chunks.tobytes())
    return b"".join(out)


class Segment:
    """Reads a segment: token(i) touches a byte and a rank a level; ids(a, b) decodes a range."""

    def __init__(self, payload: bytes):
        magic, n_levels, self.n_docs, self.n_ids = struct.unpack_from(_HEAD, payload)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = struct.calcsize(_HEAD)

        def view(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        numbers = view("<i8", self.n_docs)
        nulls = np.unpackbits(view("u1", (self.n_docs + 7) // 8), count=self.n_docs, bitorder="little")
        self.doc_ids = [None if z else x for x, z in zip(numbers.tolist(), nulls, strict=True)]
        self.ends = view("<u8", self.n_docs)
        self.levels = []
        for _ in range(n_levels):
            n, more = struct.unpack_from(_LEVEL, payload, at)
            at += struct.calcsize(_LEVEL)
            bits = view("u1", (n + 7) // 8) if more else None
            ranks = view("<u4", -(-n // BLOCK)) if more else None
            self.levels.append((view("u1", n), bits, ranks))

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        out = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << 8 * k
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                return out
            i = self._rank(bits, ranks, i)
        return out

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before bit i."""
        block = i // BLOCK
        inside = bits[block * BLOCK // 8 : i >> 3]
        part = int(bits[i >> 3]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(ranks[block]) + int(np.bitwise_count(inside).sum()) + part.bit_count()

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else stop
        return self._range(0, start, stop) if stop > start else np.zeros(0, "<u4")

    def _range(self, k: int, start: int, stop: int) -> np.ndarray:
        chunks, bits, ranks = self.levels[k]
        out = chunks[start:stop].astype("<u4")
        if bits is not None:
            more = np.unpackbits(bits[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :][: stop - start].astype(bool)
            if n := int(more.sum()):
                first = self._rank(bits, ranks, start)
                out[more] |= self._range(k + 1, first, first + n) << np.uint32(8)
        return out


def _written(path: str, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, shard = Encoder(path), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        segment, before, held, names, lengths, size = 0, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            payload = encode(np.frombuffer(b"".join(held), "<u4"), names, lengths)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], ["shard", "segment", "before", "n_tokens", "payload"])

        for b in slices(batches):
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids = encoder.ids(text) + end
                held.append(ids)
                names.append(doc_id)
                lengths.append(len(ids) // 4)
                size += len(ids) // 4
                if size >= segment_ids:
                    yield close()
                    segment, before, held, names, lengths, size = segment + 1, before + size, [], [], [], 0
        if names:
            yield close()

    return run


def write_tokens(docs: DataFrame, to: str, path: str, end_id: int = END_ID, shards: int | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode whole texts, each with end_id after it, and write their segments to folder ``to`` in ascending doc_id order."""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if shards is None:
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, -(-size // SHARD_BYTES))
    ordered = source.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(_written(path, end_id, segment_ids), SEGMENTS).write.parquet(to)


_READ = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(bases: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, before, payload in zip(b["shard"].to_pylist(), b["before"].to_pylist(), b["payload"].to_pylist(), strict=True):
                x = Segment(payload)
                ids, ends = x.ids().tobytes(), x.ends.astype(np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                crcs = [zlib.crc32(ids[4 * p : 4 * q]) for p, q in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x.doc_ids, pa.int64()), pa.array(starts + (before + bases[shard])), pa.array(ends - starts), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_documents(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files. The driver holds one number a shard."""
    segments = spark.read.schema(SEGMENTS).parquet(at)
    bases, total = {}, 0
    for shard, n in sorted(map(tuple, segments.groupBy("shard").agg(F.sum("n_tokens")).collect())):
        bases[shard] = total
        total += n
    return segments.select("shard", "before", "payload").mapInArrow(_read(bases), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_documents(docs: DataFrame, path: str, to: str | None = None, **options) -> DataFrame:
    """Write docs to token files and read them back."""
    to = to or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, to, path, **options)
    return read_documents(docs.sparkSession, to)
