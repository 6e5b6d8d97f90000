"""Words in packed lists, dealt to parts by their hash.

Counts of words and questions about words are many small things. They travel as one
row for a part and a batch: the words, joined by spaces, and arrays of numbers beside
them, compressed. Equal words meet in one part, whose share of the table is one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text for each part.
PART_BYTES = 8 << 20


def number(docs: DataFrame, size: int = PART_BYTES) -> int:
    """How many parts a table of texts gets: one for each so many bytes."""
    return max(1, math.ceil((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / size))


def pack(x: np.ndarray) -> bytes:
    return x.size.to_bytes(8, "little") + (pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True) if x.size else b"")


def unpack(data: bytes, kind: str) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def part_of(words: Iterable[str | bytes], parts: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) % parts for w in words], np.int64)


def dealt(words: list, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of the words by part, and (part, from, to) of each part that has some."""
    at = part_of(words, parts)
    order = np.argsort(at, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(at[order])) + 1).tolist(), len(words)]
    return order, [(int(at[order[lo]]), lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi > lo]
