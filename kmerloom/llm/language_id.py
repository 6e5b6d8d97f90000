"""Language ID by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to
its character n-grams, with marks for its ends: the longest length of which any n-gram
is known decides, by the mean log frequency of those. A text gets the language
with the highest sum; its score is that language's share of the likelihood.

Counts cover all labelled training rows, and every word and n-gram counts. Those whose
share of the counts is above 1 / TABLE, at most TABLE each, go to every task. The other
words of a batch of texts are sent once each, packed, to the part of the table that
their hash names, and their counts come back; n-grams of unseen words meet theirs in a join.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is
everything if no row is labelled (``accepted`` then keeps all texts with a letter); ties go to the first language by
code point; repeated rows are predicted each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import parts as pt
from .common import Shared, fold, row_ids, slices, stored

FOLDS, HELD_OUT = 4, 2
TABLE = 1 << 17
LONGEST = 4
SMOOTHING = 0.5
#: Distinct words whose vectors a task keeps, and words that its counters hold.
CACHE, FLUSH = 100_000, 300_000
#: Bytes of text whose rare words are asked for together.
BATCH_BYTES = 4 << 20
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    """Lower-case words of letters and letter-like numbers; those without a letter are passed over later."""
    return _WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    w = f"\x02{word}\x03"
    return [w[i : i + n] for i in range(len(w) - n + 1)] if n > 1 else list(word)


_COUNTED = pa.schema([("part", pa.int64()), ("lang", pa.int32()), ("words", pa.string()), ("c", pa.binary())])
_COUNTED_DDL = "part long, lang int, words string, c binary"


def _counted(langs: list[str], parts: int):
    """Packed counts of the words with a letter, by part and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = {x: i for i, x in enumerate(langs)}, [Counter() for _ in langs]

        def flush() -> pa.RecordBatch:
            rows = []
            for lang, counter in enumerate(seen):
                words = [w for w in counter if any(map(str.isalpha, w))]
                order, cuts = pt.dealt(words, parts)
                for part, lo, hi in cuts:
                    some = [words[i] for i in order[lo:hi].tolist()]
                    rows.append((part, lang, " ".join(some), pt.pack(np.array([counter[w] for w in some], np.int64))))
                counter.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_COUNTED)], schema=_COUNTED)

        for b in slices(batches):
            for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
                seen[at[lang]].update(letters(text))
            if sum(map(len, seen)) > FLUSH:
                yield flush()
        if any(seen):
            yield flush()

    return run


_TABLE = pa.schema([("part", pa.int64()), ("words", pa.string()), ("c", pa.binary()), ("totals", pa.list_(pa.int64())), ("distinct", pa.int64())])
_TABLE_DDL = "part long, words string, c binary, totals array<long>, distinct long"


def _merged(n: int):
    """The row of one part: its words, the matrix of their counts by language, and sums."""

    def run(table: pa.Table) -> pa.Table:
        lists = [w.split(" ") for w in table["words"].to_pylist()]
        at = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(lists)))}
        counts = np.zeros((len(at), n), np.int64)
        for words, lang, c in zip(lists, table["lang"].to_pylist(), table["c"].to_pylist(), strict=True):
            counts[np.fromiter(map(at.__getitem__, words), np.int64, len(words)), lang] += pt.unpack(c, "i8")  # a word is once in a list
        return pa.Table.from_pylist([{"part": table["part"][0].as_py(), "words": " ".join(at), "c": pt.pack(counts), "totals": counts.sum(axis=0).tolist(), "distinct": len(at)}], schema=_TABLE)

    return run


def _rows_of(n: int, least: float = 0):
    """word and c (by language) of a packed table's words with at least so many occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, c in zip(b["words"].to_pylist(), b["c"].to_pylist(), strict=True):
                words, counts = words.split(" "), pt.unpack(c, "i8").reshape(-1, n)
                some = np.flatnonzero(counts.sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in some.tolist()], pa.string()), pa.array(list(counts[some]), pa.list_(pa.int64()))], ["word", "c"])

    return run


def _gram_counts(n: int):
    """n, gram and counts by language of a packed table's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, str], np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.list_(pa.int64()))], ["n", "gram", "c"])
            seen.clear()
            return out

        for b in batches:
            for words, c in zip(b["words"].to_pylist(), b["c"].to_pylist(), strict=True):
                for word, counts in zip(words.split(" "), pt.unpack(c, "i8").reshape(-1, n), strict=True):
                    for length in range(1, LONGEST + 1):
                        for g in grams(word, length):
                            if (x := seen.get((length, g))) is None:
                                seen[length, g] = counts.copy()
                            else:
                                x += counts
                    if len(seen) > FLUSH // 2:
                        yield flush()
        if seen:
            yield flush()

    return run


class Model:
    """Languages in order; tables[0] of words and tables[n] of n-grams: rows of the matrix of log frequencies by language."""

    def __init__(self, langs: list[str], tables: list[dict[str, np.ndarray]]):
        self.langs = langs
        self.tables, vectors = [], []
        for t in tables:
            self.tables.append({k: len(vectors) + i for i, k in enumerate(t)})
            vectors += t.values()
        self.matrix = np.array(vectors, np.float64).reshape(len(vectors), len(langs))

    def rows(self, word: str) -> list[int] | None:
        """Rows whose mean is the word's vector, none if nothing of it is known; None if there is no letter in it."""
        if (known := self.tables[0].get(word)) is not None:
            return [known]
        if not any(map(str.isalpha, word)):
            return None
        for n in range(LONGEST, 0, -1):
            if found := [x for x in map(self.tables[n].get, grams(word, n)) if x is not None]:
                return found
        return []

    def means(self, rows: list[list[int]]) -> np.ndarray:
        """The mean of each list of rows, zero for an empty one."""
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        out = np.zeros((len(rows), len(self.langs)))
        if full := int((n > 0).sum()):
            starts = np.concatenate(([0], np.cumsum(n[n > 0])))[:full]
            out[n > 0] = np.add.reduceat(self.matrix[np.fromiter(chain.from_iterable(rows), np.int64)], starts) / n[n > 0, None]
        return out

    def vector(self, word: str) -> np.ndarray | None:
        rows = self.rows(word)
        return None if rows is None else self.means([rows])[0]


class Fitted(NamedTuple):
    """The model of what goes to every task; all words, packed by part, and all n-grams with c, their counts by language (both stored); log of each table's denominators by language."""

    model: Model
    words: DataFrame | None
    parts: int
    grams: DataFrame | None
    sizes: np.ndarray


def _size(totals: list[int], distinct: int) -> np.ndarray:
    return np.log(np.array(totals) + SMOOTHING * max(1, distinct))


def _logs(found: list, key: str, size: np.ndarray) -> dict[str, np.ndarray]:
    return {x[key]: np.log(np.array(x.c) + SMOOTHING) - size for x in found}


def fit(train: DataFrame) -> Fitted:
    """train: text and lang. Languages are few and go to the driver, as do the frequent words and n-grams."""
    source = train.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    langs = sorted(x.lang for x in source.select("lang").distinct().collect())
    none = Fitted(Model([], [{} for _ in range(LONGEST + 1)]), None, 1, None, np.zeros((LONGEST + 1, 0)))
    if not langs:
        return none
    parts = pt.number(source)
    packed = stored(source.mapInArrow(_counted(langs, parts), _COUNTED_DDL).groupBy("part").applyInArrow(_merged(len(langs)), _TABLE_DDL), "lang-words")
    sums = lambda df: df.agg(*[F.coalesce(F.sum(F.col("totals")[i]), F.lit(0)) for i in range(len(langs))], F.coalesce(F.sum("distinct"), F.lit(0))).first()
    *totals, distinct = sums(packed)
    if used := [i for i, x in enumerate(totals) if x]:
        if len(used) < len(langs):  # languages without a word are none
            return fit(train.where(F.col("lang").isin([langs[i] for i in used])))
    else:
        return none
    n = len(langs)
    sizes = [_size(totals, distinct)]
    tables = [_logs(packed.mapInArrow(_rows_of(n, sum(totals) / TABLE), "word string, c array<long>").collect(), "word", sizes[0])]
    each = packed.repartition(parts).mapInArrow(_gram_counts(n), "n int, gram string, c array<long>").groupBy("n", "gram").agg(*[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(n)])
    grams_ = stored(each.select("n", "gram", F.array(*[f"c{i}" for i in range(n)]).alias("c")), "lang-grams")
    by = {x.n: x for x in grams_.groupBy("n").agg(F.array(*[F.sum(F.col("c")[i]) for i in range(n)]).alias("totals"), F.count("*").alias("distinct")).collect()}
    for length in range(1, LONGEST + 1):
        x = by.get(length)
        sizes.append(_size(x.totals, x.distinct) if x else _size([0] * n, 0))
        frequent = grams_.where(F.col("n") == length).where(sum((F.col("c")[i] for i in range(n)), F.lit(0)) * TABLE >= (sum(x.totals) if x else 0))
        tables.append(_logs(frequent.select("gram", "c").collect(), "gram", sizes[-1]))
    return Fitted(Model(langs, tables), packed, parts, grams_, np.array(sizes))


class _Places(dict):
    """Number of each word among those met; -1 without a letter. ``fresh``: rows of the words met since they were last taken."""

    def __init__(self, model: Model):
        self.model, self.fresh, self.met = model, [], 0

    def __missing__(self, word: str) -> int:
        rows = self.model.rows(word)
        if rows is None:
            self[word] = -1
            return -1
        at = self[word] = self.met
        self.met += 1
        self.fresh.append(rows)
        return at


class Predictor:
    """Languages and scores of texts; keeps the vectors of the words that it has met, up to CACHE."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.places, self.table = _Places(self.model), np.zeros((1024, len(self.model.langs)))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.places) > CACHE:
            self._forget()
        found = [np.fromiter(map(self.places.__getitem__, letters(text)), np.int64) for text in texts]
        self._fill()
        names, scores = [], []
        for at in found:
            at = at[at >= 0]
            if not len(at) or not self.model.langs:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = self.table[at].sum(axis=0)
            best = int(total.argmax())
            names.append(self.model.langs[best])
            scores.append(1 / float(np.exp(total - total[best]).sum()))
        return names, scores

    def _fill(self) -> None:
        """Vectors of the fresh words go into the table, whose room is doubled when it is full."""
        p = self.places
        filled, n = p.met - len(p.fresh), p.met
        if n > len(self.table):
            self.table = np.concatenate((self.table[:filled], np.zeros((2 * n - filled, self.table.shape[1]))))
        if p.fresh:
            self.table[filled:n] = self.model.means(p.fresh)
            p.fresh = []


_ROWS = pa.schema([("doc_id", pa.list_(pa.int64())), ("n", pa.binary()), ("sums", pa.binary()), ("ends", pa.binary()), ("at", pa.binary()), ("times", pa.binary()), ("asked", pa.list_(pa.struct([("part", pa.int64()), ("fresh", pa.string()), ("words", pa.string())])))])
_ROWS_DDL = "doc_id array<long>, n binary, sums binary, ends binary, at binary, times binary, asked array<struct<part:long,fresh:string,words:string>>"


def _looked_up(shared, parts: int):
    """A row for each batch of texts: how many words of each have a letter, the sums of the frequent ones' vectors, and the others.

    The others are in ``asked`` by part, each once: ``fresh`` those of texts that were not trained on, which may be
    unseen, then ``words``. at: their numbers in that order, text by text (up to ``ends``), with how often they occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        places, missing = model.tables[0], len(model.matrix)
        columns = [np.append(x, 0.0) for x in model.matrix.T]
        for b in slices(batches, size=BATCH_BYTES):
            lists = [letters(t) for t in b["text"].to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(x) + 1 for x in lists]))).astype(np.int64)
            at = np.fromiter(map(places.get, chain.from_iterable(chain(x, ("",)) for x in lists), repeat(missing)), np.int64, int(ends[-1]))
            sums = np.stack([np.add.reduceat(x[at], ends[:-1]) for x in columns], axis=1)
            rare = [Counter([w for i in np.flatnonzero(at[a : a + len(x)] == missing).tolist() if (w := x[i]).isalpha() or any(map(str.isalpha, w))]) for x, a in zip(lists, ends.tolist(), strict=False)]
            n = np.add.reduceat((at != missing).astype(np.int64), ends[:-1]) + np.array([x.total() for x in rare], np.int64)
            trained = b["trained"].to_pylist()
            known = set(chain.from_iterable(x for x, t in zip(rare, trained, strict=True) if t))
            words = list(dict.fromkeys(chain.from_iterable(rare)))
            order, cuts = pt.dealt(words, parts)
            asked, number = [], {}
            for part, lo, hi in cuts:
                some = [words[i] for i in order[lo:hi].tolist()]
                fresh, rest = [w for w in some if w not in known], [w for w in some if w in known]
                for w in chain(fresh, rest):
                    number[w] = len(number)
                asked.append({"part": part, "fresh": " ".join(fresh), "words": " ".join(rest)})
            row = {
                "doc_id": b["doc_id"].to_pylist(), "n": pt.pack(n), "sums": pt.pack(sums), "ends": pt.pack(np.cumsum([len(x) for x in rare])), "asked": asked,
                "at": pt.pack(np.fromiter(map(number.__getitem__, chain.from_iterable(rare)), np.int32)), "times": pt.pack(np.fromiter(chain.from_iterable(x.values() for x in rare), np.int64)),
            }
            yield pa.RecordBatch.from_pylist([row], schema=_ROWS)

    return run


def _split(words: str | None) -> list[str]:
    return words.split(" ") if words else []


def _unseen(asked: pa.Table, table: pa.Table) -> pa.Table:
    """The asked words of a part, each once, that its table lacks."""
    known = set(_split(table["words"][0].as_py())) if len(table) else set()
    return pa.table({"word": pa.array([w for w in dict.fromkeys(chain.from_iterable(map(_split, asked["fresh"].to_pylist()))) if w not in known], pa.string())})


def _in_parts(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pt.part_of(b["word"].to_pylist(), parts)), b["word"], pa.nulls(b.num_rows, pa.binary()), b["v"]], ["part", "words", "c", "v"])

    return run


_REPLY = pa.schema([("uid", pa.int64()), ("part", pa.int64()), ("c", pa.binary()), ("new", pa.binary()), ("v", pa.binary())])
_REPLY_DDL = "uid long, part long, c binary, new binary, v binary"


def _replied(n: int):
    """For each question the counts of its words by language; for unseen words (new: their numbers) the vectors."""

    def run(asked: pa.Table, table: pa.Table) -> pa.Table:
        if not len(asked):
            return _REPLY.empty_table()
        words, counts, backoff = [], [np.zeros((0, n), np.int64)], {}
        for w, c, v in zip(table["words"].to_pylist(), table["c"].to_pylist(), table["v"].to_pylist(), strict=True):
            if c is None:
                backoff[w] = v
            else:
                words += _split(w)
                counts.append(pt.unpack(c, "i8").reshape(-1, n))
        at = {w: i for i, w in enumerate(words)}
        counts = np.concatenate((*counts, np.zeros((1, n), np.int64)))
        out = []
        for uid, part, fresh, rest in zip(asked["uid"].to_pylist(), asked["part"].to_pylist(), asked["fresh"].to_pylist(), asked["words"].to_pylist(), strict=True):
            mine = _split(fresh) + _split(rest)
            rows = np.fromiter(map(at.get, mine, repeat(len(words))), np.int64, len(mine))
            new = [i for i in np.flatnonzero(rows == len(words)).tolist() if mine[i] in backoff]
            out.append({"uid": uid, "part": part, "c": pt.pack(counts[rows]), "new": pt.pack(np.array(new, np.int32)), "v": pt.pack(np.array([backoff[mine[i]] for i in new], np.float64))})
        return pa.Table.from_pylist(out, schema=_REPLY)

    return run


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
_PREDICTED_DDL = "doc_id long, lang_pred string, score double"


def _decided(langs: list[str], size: np.ndarray):
    """Languages and scores of the texts of a batch, from its row and the replies to it."""

    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        replies = replies.sort_by("part")
        vectors = []
        for c, new, v in zip(replies["c"].to_pylist(), replies["new"].to_pylist(), replies["v"].to_pylist(), strict=True):
            counts = pt.unpack(c, "i8").reshape(-1, len(langs))
            x = np.where(counts.any(axis=1)[:, None], np.log(counts + SMOOTHING) - size, 0.0)
            x[pt.unpack(new, "i4")] = pt.unpack(v, "f8").reshape(-1, len(langs))
            vectors.append(x)
        vectors = np.concatenate(vectors) if vectors else np.zeros((0, len(langs)))
        row = rows.to_pylist()[0]
        totals, ends, at, times = pt.unpack(row["sums"], "f8").reshape(-1, len(langs)).copy(), pt.unpack(row["ends"], "i8"), pt.unpack(row["at"], "i4"), pt.unpack(row["times"], "i8")
        if full := np.flatnonzero(np.diff(ends, prepend=0)).tolist():
            starts = np.concatenate(([0], ends[:-1]))[full]
            totals[full] += np.add.reduceat(vectors[at] * times[:, None], starts)
        best = totals.argmax(axis=1)
        share = 1 / np.exp(totals - totals[np.arange(len(best)), best][:, None]).sum(axis=1)
        some = pt.unpack(row["n"], "i8") > 0
        return pa.table([pa.array(row["doc_id"], pa.int64()), pa.array([langs[i] if ok else UNDETERMINED for i, ok in zip(best.tolist(), some.tolist(), strict=True)]), pa.array(np.where(some, share, 0.0))], schema=_PREDICTED)

    return run


def _parts(shared):
    """For an unseen word and each length, from the longest to the first with a frequent n-gram: number and sums of the frequent n-grams, and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            out = []
            for word in b["word"].to_pylist():
                for n in range(LONGEST, 0, -1):
                    all_, t = grams(word, n), model.tables[n]
                    found = [t[g] for g in all_ if g in t]
                    out.append((word, n, len(found), model.matrix[found].sum(axis=0), [g for g in all_ if g not in t]))
                    if found:
                        break
            types = (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["word", "n", "k", "sums", "rare"])

    return run


def unseen_vectors(unseen: DataFrame, fitted: Fitted, shared: Shared) -> DataFrame:
    """word and v, its vector by its n-grams, of words (each once) that are not trained, stored; those of which nothing is known are left out."""
    langs = range(len(fitted.model.langs))
    size = lambda i: F.element_at(F.array(*[F.lit(float(x)) for x in fitted.sizes[1:, i]]), F.col("n"))
    known = fitted.grams.select("n", "gram", *[(F.ln(F.col("c")[i] + SMOOTHING) - size(i)).alias(f"v{i}") for i in langs])
    parts = stored(unseen.mapInArrow(_parts(shared), "word string, n int, k long, sums array<double>, rare array<string>"), "lang-unseen")
    rare = parts.select("word", "n", F.explode("rare").alias("gram")).join(known, ["n", "gram"])
    more = rare.groupBy("word", "n").agg(F.count("*").alias("m"), *[F.sum(f"v{i}").alias(f"v{i}") for i in langs])
    k = F.col("k") + F.coalesce("m", F.lit(0))
    means = parts.join(more, ["word", "n"], "left").where(k > 0).select("word", "n", F.array(*[(F.col("sums")[i] + F.coalesce(f"v{i}", F.lit(0.0))) / k for i in langs]).alias("v"))
    return stored(means.groupBy("word").agg(F.max_by("v", "n").alias("v")), "lang-backoff")


def _accepted(shared):
    """The rows that get a language, with all their columns. Whether, not which, counts here, and no table decides it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for b in slices(batches):
            texts = b["text"].to_pylist()
            if predictor.model.langs:
                kept = [x != UNDETERMINED for x in predictor(texts)[0]]
            else:
                kept = [any(any(map(str.isalpha, w)) for w in letters(x)) for x in texts]
            yield b.filter(pa.array(kept, pa.bool_()))

    return run


def predict(docs: DataFrame, fitted: Fitted, trained: Column | None = None) -> DataFrame:
    """doc_id, lang_pred and score; only the text is looked at. trained: which rows were fitted, so that all their words are known."""
    langs = fitted.model.langs
    if not langs:
        return docs.select(F.col("doc_id").cast("long"), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = Shared(docs.sparkSession, fitted.model)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.lit(False) if trained is None else trained, F.lit(False)).alias("trained"))
    rows = stored(row_ids(source.mapInArrow(_looked_up(shared, fitted.parts), _ROWS_DDL)), "lang-rows")
    asked = rows.select("uid", F.explode("asked").alias("x")).select("uid", "x.*")
    by_part = fitted.words.select("part", "words").groupBy("part")
    unseen = asked.where("fresh <> ''").select("part", "fresh").groupBy("part").cogroup(by_part).applyInArrow(_unseen, "word string")
    backoff = unseen_vectors(unseen, fitted, shared)
    table = fitted.words.select("part", "words", "c", F.lit(None).cast("array<double>").alias("v")).unionByName(backoff.mapInArrow(_in_parts(fitted.parts), "part long, words string, c binary, v array<double>"))
    replies = asked.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(_replied(len(langs)), _REPLY_DDL)
    return rows.drop("asked").groupBy("uid").cogroup(replies.groupBy("uid")).applyInArrow(_decided(langs, fitted.sizes[0]), _PREDICTED_DDL)


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold and predict all."""
    fitted = fit(docs.where(fold("doc_id", FOLDS) != HELD_OUT))
    return predict(docs, fitted, (fold("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull()).select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, that have a language; if none was learnt, those that have a letter."""
    shared = Shared(docs.sparkSession, fit(docs.where(fold("doc_id", FOLDS) != HELD_OUT)).model)
    return docs.mapInArrow(_accepted(shared), docs.schema)
