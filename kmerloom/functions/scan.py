"""The places of some wanted k-mers in sequences: a pass over the letters as numbers, that makes rows of what it finds only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .alphabet import BREAK, Alphabet
from .kmers import fits_code

#: Letters that are numbered at a time.
STEP = 1 << 20
#: Counts up to so many possible k-mers, for so many keys, stay in a task until its end.
DENSE, KEYS = 1 << 20, 32
#: Windows that are hashed at a time, few enough to stay in a core's cache.
BLOCK = 1 << 16
#: Odd numbers of the windows' hashes.
FACTOR, MIXES = 0x01000193, (0x9E3779B1, 0x85EBCA77)
#: A letter that cuts, as a byte.
CUT = 255


def digits(alphabet: Alphabet) -> np.ndarray:
    """The number of each ASCII character's letter after ``Alphabet.normalise``; the last entry is that of all other characters, -1 cuts."""
    other = -1 if alphabet.unknown == BREAK else alphabet.letters.index(alphabet.unknown)
    out = np.full(129, other, np.int8)
    for i in range(128):
        c = chr(i).upper() if alphabet.fold_case else chr(i)
        c = {"U": "T", "u": "t"}.get(c, c) if alphabet.uracil else c
        if c in alphabet.letters:
            out[i] = alphabet.letters.index(c)
    return out


def codes(letters: np.ndarray, k: int, base: int) -> np.ndarray:
    """The number in ``base`` of each window of k digits, from those of windows of half the length."""
    if k == 1:
        return letters.astype(np.int64)
    half = k // 2
    short = codes(letters, half, base)
    n = len(letters) - k + 1
    out = short[:n] * base**half + short[half : half + n]
    return out * base + letters[k - 1 :] if k % 2 else out


def numbered(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters' numbers of all texts in a row, and where each text ends."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return table[np.minimum(points, 128)], np.cumsum([len(t) for t in texts], dtype=np.int64)


def windows(texts: list[str], k: int, table: np.ndarray, base: int) -> Iterator[np.ndarray]:
    """Numbers of all windows of the texts that hold no cut, a step at a time."""
    letters, ends = numbered(texts, table)
    bad = np.zeros(len(letters) + 1, bool)
    for i in range(1, k):  # windows that cross an end
        bad[np.maximum(ends - i, 0)] = True
    for i in range(k) if (cut := letters < 0).any() else ():
        bad[: len(letters) - i] |= cut[i:]
    letters = np.maximum(letters, 0)
    for at in range(0, len(letters) - k + 1, STEP):
        c = codes(letters[at : at + STEP + k - 1], k, base)
        yield c[~bad[at : at + len(c)]]


def spelled(numbers: np.ndarray, k: int, alphabet: Alphabet) -> pa.Array:
    """The k-mers of numbers."""
    base, letters = len(alphabet.letters), np.frombuffer(alphabet.letters.encode(), np.uint8)
    out = np.stack([letters[numbers // base ** (k - 1 - i) % base] for i in range(k)], axis=1) if len(numbers) else np.zeros((0, k), np.uint8)
    return pa.array(np.ascontiguousarray(out).view(f"S{k}").ravel(), pa.binary()).cast(pa.string())


def _counted(k: int, alphabet: Alphabet, n_keep: int):
    table, base = digits(alphabet), len(alphabet.letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense: dict[tuple, np.ndarray] = {}
        schema = None

        def shown(key: tuple, numbers: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            fixed = [pa.array([x], f.type).take(pa.array(np.zeros(len(n), np.int64))) for x, f in zip(key, schema, strict=False)]
            return pa.RecordBatch.from_arrays([*fixed, spelled(numbers, k, alphabet), pa.array(n.astype(np.int64))], [*schema.names[:n_keep], "kmer", "n"])

        def emptied() -> Iterator[pa.RecordBatch]:
            while dense:
                key, n = dense.popitem()
                yield shown(key, at := np.flatnonzero(n), n[at])

        for b in batches:
            schema, held = b.schema, {}
            for *key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if text and len(text) >= k:
                    held.setdefault(tuple(key), []).append(text)
            for key, texts in held.items():
                if base**k <= DENSE:
                    if key not in dense and len(dense) >= KEYS:
                        yield from emptied()
                    n = dense.setdefault(key, np.zeros(base**k, np.int64))
                    for c in windows(texts, k, table, base):
                        n += np.bincount(c, minlength=len(n))
                else:
                    for c in windows(texts, k, table, base):
                        yield shown(key, *np.unique(c, return_counts=True))
        yield from emptied()

    return run


def count_kmers(df: DataFrame, seq: str, k: int, keep: list[str], alphabet: Alphabet) -> DataFrame:
    """keep, kmer and n: as ``explode_kmers``, counted within tasks as far as they reach; a k-mer may come from several."""
    source = df.select(*keep, F.col(seq).cast("string"))
    if not fits_code(k, alphabet):
        raise ValueError("these k-mers are no numbers")
    schema = StructType([*source.schema.fields[:-1], StructField("kmer", StringType()), StructField("n", LongType())])
    return source.mapInArrow(_counted(k, alphabet, len(keep)), schema)


def _summed(k: int, alphabet: Alphabet):
    table, base = digits(alphabet), len(alphabet.letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, first, last = [], [], []
            for i, texts in enumerate(b.column(1).to_pylist()):
                texts = [t for t in texts if len(t) >= k]
                c = np.concatenate([np.zeros(0, np.int64), *windows(texts, k, table, base)])
                if len(c):
                    each = np.unique(c)
                    rows.append((i, len(c), len(each), max(map(len, texts)) - k))
                    first.append(each[0])
                    last.append(each[-1])
            at, n, distinct, pos = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else [()] * 4))
            ends = [spelled(np.array(x, np.int64), k, alphabet) for x in (first, last)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(n), pa.array(distinct), *ends, pa.array(pos)], ["seq_id", "n", "n_distinct", "first", "last", "last_pos"])

    return run


def summaries(df: DataFrame, k: int, alphabet: Alphabet) -> DataFrame:
    """seq_id, n, n_distinct, first, last and last_pos of the k-mers of each seq_id, for alphabets that nothing cuts; only the texts move."""
    if not fits_code(k, alphabet) or alphabet.unknown == BREAK:
        raise ValueError("these k-mers are no numbers, or are cut")
    each = df.where("seq IS NOT NULL").groupBy("seq_id").agg(F.collect_list("seq").alias("seqs"))
    kind = each.schema["seq_id"].dataType.simpleString()
    return each.mapInArrow(_summed(k, alphabet), f"seq_id {kind}, n long, n_distinct long, first string, last string, last_pos long")


def _hashed(letters: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of each window of k digits, from those of windows of half the length as ``codes``."""
    if k == 1:
        return letters.astype(np.uint32)
    half = k // 2
    short = _hashed(letters, half)
    n = len(letters) - k + 1
    out = short[:n] * np.uint32(pow(FACTOR, half, 1 << 32))
    out += short[half : half + n]
    if k % 2:
        out *= np.uint32(FACTOR)
        out += letters[k - 1 :]
    return out


def _translation(alphabet: Alphabet) -> tuple[bytes, bytes]:
    """The letters' numbers by byte of UTF-8, where a character's first byte stands for it, and the bytes that go."""
    table = digits(alphabet).astype(np.uint8)
    return bytes(table[:128]) + bytes(table[128:]) * 128, bytes(range(0x80, 0xC0))


def _found(k: int, alphabet: Alphabet, wanted: np.ndarray, n_keep: int):
    table, gone = _translation(alphabet)
    base, bits = len(alphabet.letters), min(24, max(16, 5 + len(wanted).bit_length()))
    place = lambda h, mix: (h * np.uint32(mix)) >> np.uint32(32 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
        spelt = np.zeros(len(wanted), np.uint32)
        for j in range(k):
            spelt = spelt * np.uint32(FACTOR) + (wanted // base ** (k - 1 - j) % base).astype(np.uint32)
        first[place(spelt, MIXES[0])] = second[place(spelt, MIXES[1])] = True

        def hits(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Where windows start that are wanted, whether or not they cross texts, and their numbers; none holds a cut."""
            step, at = min(BLOCK, STEP), [np.zeros(0, np.int64)]
            for lo in range(0, len(letters) - k + 1, step):
                h = _hashed(letters[lo : lo + step + k - 1], k)
                near = np.flatnonzero(first.take(place(h, MIXES[0])))
                at.append(near[second[place(h[near], MIXES[1])]] + lo)
            at = np.concatenate(at)
            kmer, whole = np.zeros(len(at), np.int64), np.ones(len(at), bool)
            for j in range(k):
                letter = letters[at + j]
                kmer = kmer * base + letter
                whole &= letter != CUT
            i = np.searchsorted(wanted, kmer)
            is_wanted = whole & (wanted[np.minimum(i, len(wanted) - 1)] == kmer)
            return at[is_wanted], kmer[is_wanted]

        def parts(b: pa.RecordBatch) -> Iterator[tuple[int, pa.Array]]:
            """Rows of about STEP bytes of text."""
            texts = pc.fill_null(b.column(n_keep).cast(pa.large_string()), "")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(sizes // STEP)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                yield lo, texts.slice(lo, hi - lo)

        for b in batches:
            for row, texts in parts(b) if b.num_rows else ():
                bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                data = memoryview(texts.buffers()[2] or b"")[bounds[0] : bounds[-1]].tobytes()
                letters = np.frombuffer(data.translate(table, gone), np.uint8)
                at, kmer = hits(letters)
                lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(lengths)
                of = np.searchsorted(ends, at, "right")
                inside = at + k <= ends[of]
                at, of, kmer = at[inside], of[inside], kmer[inside]
                kept = [c.take(pa.array(of + row)) for c in b.columns[:n_keep]]  # not the texts
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lengths[of] - k + 1), pa.array(at - (ends - lengths)[of]), pa.array(kmer)], [*b.schema.names[:n_keep], "n_kmers", "pos", "kmer"])

    return run


def find_kmers(df: DataFrame, seq: str, k: int, keep: list[str], alphabet: Alphabet, wanted: list[int]) -> DataFrame:
    """As ``explode_kmers`` with numbers (``code``) for k-mers, of the wanted ones only: keep, n_kmers, pos, kmer. ``wanted`` goes to every task."""
    source = df.select(*keep, F.col(seq).cast("string"))
    schema = StructType([*source.schema.fields[:-1], *(StructField(c, LongType()) for c in ("n_kmers", "pos", "kmer"))])
    if not wanted:
        return df.sparkSession.createDataFrame([], schema)
    return source.mapInArrow(_found(k, alphabet, np.unique(np.array(wanted, np.int64)), len(keep)), schema)
