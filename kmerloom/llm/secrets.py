"""Secret scans by grammar inference.

Known formats (assignments, access keys, hexadecimal strings) are matched as they are.
Their matches are the labelled credentials from which, for each format, a probabilistic
automaton is inferred: the prefix tree of the strings, whose states are merged where
their next-symbol and end frequencies agree within Hoeffding bounds. Every candidate
string of a text is scored by each automaton's likelihood against that of ordinary
candidates; those well above are added as spans of kind ``format``.

The automata are learnt from a bounded sample of labelled credentials: FIT_STRINGS distinct ones
of a format of at most FIT_LENGTH characters, least by hash, each as a whole. What ordinary
strings are made of is counted over all candidates, and all of them are scored as a whole.
A candidate is a run of LEAST or more characters of keys; shorter ones are not told from words.

Defined cases: null text is empty; empty texts have no spans; spans count code points;
without credentials nothing is added; repeated rows are scanned each; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, slices, stored

#: The formats' patterns and least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")
ADDED = "format"

_ASSIGN = re.compile(ASSIGN, re.I | re.A)  # re.A: no letters beyond ASCII that fold to these
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Least length of a candidate.
LEAST = 12
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
#: Labelled credentials of a format that its automaton is learnt from, and the longest of them.
FIT_STRINGS, FIT_LENGTH = 400, 512
ALPHA = 0.05
#: Log likelihood (nats) by which a format must beat ordinary text.
MARGIN = 12.0


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, kind, credential: leftmost non-overlapping matches of each kind, without those too short."""
    found = [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """Runs of key characters that no base span overlaps."""
    covered: list[list[int]] = []  # the base spans' union, in order
    for start, end, _, _ in base:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(end, covered[-1][1])
        else:
            covered.append([start, end])
    found, at = [], 0
    for m in _CANDIDATE.finditer(text):
        while at < len(covered) and covered[at][1] <= m.start():
            at += 1
        if at == len(covered) or covered[at][0] >= m.end():
            found.append((m.start(), m.end(), m[0]))
    return found


class Automaton:
    """A probabilistic automaton; ``learn`` builds the prefix tree and merges its states (ALERGIA)."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]

    def _state(self) -> int:
        self.next.append({})
        self.seen.append({})
        self.ends.append(0)
        return len(self.next) - 1

    def add(self, s: str) -> None:
        q = 0
        for c in s:
            self.seen[q][c] = self.seen[q].get(c, 0) + 1
            if c not in self.next[q]:
                self.next[q][c] = self._state()
            q = self.next[q][c]
        self.ends[q] += 1

    def visits(self, q: int) -> int:
        return self.ends[q] + sum(self.seen[q].values())

    @staticmethod
    def _differ(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether a and b, and the states that the same symbols lead to from them, agree."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.visits(a), self.visits(b)
            if self._differ(self.ends[a], n, self.ends[b], m, alpha):
                return False
            for c in self.seen[a].keys() | self.seen[b].keys():
                if self._differ(self.seen[a].get(c, 0), n, self.seen[b].get(c, 0), m, alpha):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def merge(self, parent: int, symbol: str, red: int) -> None:
        """Lead parent's symbol to red and fold the tree below its old state into red."""
        todo = [(red, self.next[parent][symbol])]
        self.next[parent][symbol] = red
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.seen[b].items():
                self.seen[a][c] = self.seen[a].get(c, 0) + n
            for c, q in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], q))
                else:
                    self.next[a][c] = q

    def learn(self, strings: list[str], alpha: float = ALPHA) -> Automaton:
        for s in strings:
            self.add(s)
        red = [0]
        while True:
            blue = [(-self.visits(q), p, c, q) for p in red for c, q in self.next[p].items() if q not in red]
            if not blue:
                return self
            _, parent, symbol, q = min(blue)
            for r in red:
                if self.compatible(r, q, alpha):
                    self.merge(parent, symbol, r)
                    break
            else:
                red.append(q)

    def log_likelihood(self, s: str) -> float:
        """-inf where the automaton has no way through s."""
        q, out = 0, 0.0
        for c in s:
            if c not in self.next[q]:
                return -math.inf
            out += math.log(self.seen[q][c] / self.visits(q))
            q = self.next[q][c]
        return out + math.log(max(self.ends[q], 0.1) / max(1, self.visits(q)))


class Scorer:
    """Likelihood ratio of the best format against ordinary candidates, a symbol at a time."""

    def __init__(self, formats: dict[str, list[str]], counts: dict[str, int]):
        """counts: how often the candidates of all texts hold each character."""
        self.automata = [Automaton().learn(sorted(x)) for _, x in sorted(formats.items()) if x]
        total = sum(counts.values()) + 128
        self.ordinary = {chr(i): math.log((counts.get(chr(i), 0) + 1) / total) for i in range(128)}

    def ratio(self, s: str) -> float:
        best = max((a.log_likelihood(s) for a in self.automata), default=-math.inf)
        return best - sum(self.ordinary[c] for c in s)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(_SPAN)), ("others", pa.list_(_SPAN))])
_SPAN_DDL = "array<struct<start:long,end:long,kind:string,value:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found, others = [], []
        for text in b["text"].to_pylist():
            base = base_spans(text or "")
            found.append([{"start": a, "end": z, "kind": k, "value": v} for a, z, k, v in base])
            others.append([{"start": a, "end": z, "kind": ADDED, "value": v} for a, z, v in candidates(text or "", base)])
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found, pa.list_(_SPAN)), pa.array(others, pa.list_(_SPAN))], schema=_FOUND)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans of known formats) and others (candidates), stored."""
    return stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, f"doc_id long, base {_SPAN_DDL}, others {_SPAN_DDL}"), "secrets")


def _least(values: DataFrame, n: int) -> list:
    return values.distinct().orderBy(F.xxhash64("value"), "value").limit(n).collect()


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for b in batches:
        for others in b["others"].to_pylist():
            for x in others:
                counts.update(x["value"])
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["c", "n"])


def fit(found: DataFrame) -> Scorer:
    spans = found.select(F.explode("base").alias("s")).select("s.kind", F.col("s.value").alias("value")).where(F.length("value") <= FIT_LENGTH)
    formats = {k: [x.value for x in _least(spans.where(F.col("kind") == k).select("value"), FIT_STRINGS)] for k in KINDS}
    counts = found.select("others").mapInArrow(_characters, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    return Scorer(formats, {x.c: x.n for x in counts})


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = {k: i for i, k in enumerate((*KINDS, ADDED))}
    return ",".join(f"{k}:{a}:{z}" for a, z, k in sorted(spans, key=lambda x: (x[0], order[x[2]])))


_RESULT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_format", pa.int64())])
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long"


def _judged(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, known = shared.value, {}
        for b in batches:
            rows = []
            for doc_id, base, others in zip(b["doc_id"].to_pylist(), b["base"].to_pylist(), b["others"].to_pylist(), strict=True):
                mine = [(x["start"], x["end"], x["kind"]) for x in base]
                added = []
                for x in others:
                    if (hit := known.get(x["value"])) is None:
                        if len(known) > 100_000:
                            known.clear()
                        hit = known[x["value"]] = scorer.ratio(x["value"]) >= MARGIN
                    if hit:
                        added.append((x["start"], x["end"], ADDED))
                kinds = Counter(k for _, _, k in mine)
                rows.append((doc_id, *(kinds[k] for k in KINDS), hashlib.sha256(joined(mine).encode()).hexdigest(), joined(mine + added), len(added)))
            columns = zip(*rows, strict=True) if rows else [()] * len(_RESULT)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT, strict=True)], schema=_RESULT)

    return run


def secret_scan(docs: DataFrame) -> DataFrame:
    """Counts and spans of each row: those of the known formats, and those that the automata add."""
    found = scan(docs)
    shared = Shared(docs.sparkSession, fit(found))
    return found.select("doc_id", "base", "others").mapInArrow(_judged(shared), RESULT)
