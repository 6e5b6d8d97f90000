"""Best-fit packing of token pieces: bounded-space online best-fit.

Documents become token pieces of at most ``width``; each task packs a large run
of pieces as they come. A fixed number of open bins is kept in a bitset keyed by
free space; a piece goes to the bin with the least free space that holds it; when
one bin too many is open, the fullest closes.

Defined cases: null text is empty and gives the end id alone; repeated rows are
packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .tokens import Encoder

WIDTH = 4096
OPEN_BINS = 1024
END_ID = 1


class BestFit:
    """place(length) gives (bin number, offset)."""

    def __init__(self, width: int = WIDTH, open_bins: int = OPEN_BINS):
        self.width, self.most = width, open_bins
        self.bits, self.count, self.made = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.width, self.made
            self.made += 1
        if left := free - length:
            self.by_free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.count += 1
            if self.count > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.width - free


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, width: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path), end_id.to_bytes(4, "little")
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids = encoder.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * width)):
                    piece = ids[at : at + 4 * width]
                    rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

    return run


def pieces(docs: DataFrame, path: str, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces, stored."""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(source.mapInArrow(_cut(path, width, end_id), _PIECES_DDL), "pieces")


def _packed(width: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(width, open_bins), TaskContext.get().partitionId() << 40
        for b in batches:
            placed = [bins.place(n) for n in b["length"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([base + x for x, _ in placed], pa.int64()), pa.array([y for _, y in placed], pa.int64())], [*b.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, width: int = WIDTH, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    """A row for each piece with its sequence_id and offset. Pieces are small rows, so few tasks hold very many of them each."""
    return pieces(docs, path, width, end_id).mapInArrow(_packed(width, open_bins), f"{_PIECES_DDL}, sequence_id long, offset long")
