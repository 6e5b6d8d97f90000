"""Quality scores by positive-unlabelled learning.

Trusted positives are the documents that are labelled good; the unlabelled web text is
all documents outside the held-out fold, whatever their labels. A small network is
trained to the least non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with the logistic loss, so that its output is a probability. The class prior is estimated from
positives and unlabelled texts alone: a first network tells one half of a sample of both from each other, and over
the other positives and all other unlabelled texts the prior is the least share of unlabelled texts above a score for each share of
positives above it, with a margin for chance (best-bin estimation). Labels 0 are not used.

The features are how often each pair of character classes follows each other in the whole
text, and a few ratios of words. The network's hidden layer is learnt from a bounded sample, FIT_ROWS ids
of each kind, least by the hash of the id (a parameter). Its output layer is then solved over every unlabelled
text: with the logistic loss the unbiased risk is convex in it, so Newton steps, each one pass
that sums gradients over the stored hidden values, lead to the least risk; none is taken to
where the risk of negatives is below zero. Every document is scored.

Defined cases: null and empty texts have features of zero and get a score; labels other than 1
count as none; without positives every score is the prior, 0.5; of rows with one id one is in the sample; repeated rows are unlabelled texts each and are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import dropped
from .common import Shared, fold, slices, stored, words

FOLDS, HELD_OUT = 5, 0
FIT_ROWS = 6000
THRESHOLD = 0.3
#: Characters of a class each; letters, digits, white space and others have classes of their own.
_PUNCTUATION = [".", ",", ";:", "'\"`", "-_", "|", "!", "?", "#", "$%&", "*", "()[]{}", "<>", "/\\", "@=+~^"]
_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _LEAD, _REST, _CONTROL = range(len(_PUNCTUATION), len(_PUNCTUATION) + 8)
N_CLASSES = len(_PUNCTUATION) + 8
N_FEATURES = N_CLASSES**2 + 5
#: Bytes of text whose pairs are counted at once.
WINDOW = 1 << 20
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 40, 256, 0.003, 1e-4
#: Newton steps of the output layer, and the shares of a step that are tried at once.
STEPS, SHARES = 8, (1.0, 0.5, 0.25, 0.125, 1 / 32, 1 / 128)


def _class_table() -> np.ndarray:
    t = np.full(256, _CONTROL, np.int64)
    t[0x61:0x7B], t[0x41:0x5B], t[0x30:0x3A] = _LOWER, _UPPER, _DIGIT
    t[[0x20, 0x09]], t[0x0A] = _SPACE, _LINE
    t[0x80:0xC0], t[0xC0:] = _REST, _LEAD
    for i, chars in enumerate(_PUNCTUATION):
        t[list(chars.encode())] = i
    return t


CLASSES = _class_table()


def features(text: str | None) -> np.ndarray:
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        return out
    data = np.frombuffer(text.encode(), np.uint8)
    pairs = np.zeros(N_CLASSES**2, np.int64)
    for i in range(0, len(data) - 1, WINDOW):
        c = CLASSES[data[i : i + WINDOW + 1]]
        pairs += np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=N_CLASSES**2)
    out[: N_CLASSES**2] = np.log1p(pairs * (200 / max(1, len(data) - 1)))
    ws, lines = words(text), text.split("\n")
    if ws:
        out[N_CLASSES**2 :] = [len(set(ws)) / len(ws), min(20.0, sum(map(len, ws)) / len(ws)) / 20, np.log1p(len(ws)) / 10, len(set(lines)) / len(lines), len(set(zip(ws, ws[1:], strict=False))) / max(1, len(ws) - 1)]
    return out


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Network:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, prior: float, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.prior = mean, scale, prior
        bias = float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
        self.p = [rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([bias])]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(self.scaled(x))[1])

    def gradients(self, x: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        gh = g[:, None] * self.p[2] * (1 - h * h)
        return [x.T @ gh, gh.sum(axis=0), h.T @ g, np.array([g.sum()])]


class Halves:
    """A network that tells one half of the positives from one half of the unlabelled, and the other positives' scores."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        p, u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        hp, hu = len(p) // 2, len(u) // 2
        self.used, self.others = u[:hu], u[hu:]
        self.net = fit_pu(positive[p[:hp]], unlabelled[self.used], 0.5, seed)
        self.scores = np.sort(self.net.score(positive[p[hp:]]))
        self.cuts = np.unique(self.scores)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """How many unlabelled rows have 0, 1, .. of the cuts at or below their score."""
        return np.bincount(np.searchsorted(self.cuts, self.net.score(x), side="right"), minlength=len(self.cuts) + 1)

    def prior(self, bins: np.ndarray) -> float:
        """The share of positives among the unlabelled rows that bins counts, by the best bin."""
        n = int(bins.sum())
        if not n:
            return 0.5
        qp = 1 - np.searchsorted(self.scores, self.cuts) / len(self.scores)
        qu = bins[::-1].cumsum()[::-1][1:] / n
        margin = np.sqrt(np.log(2 / 0.1) / 2) * (1 / np.sqrt(len(self.scores)) + 1 / np.sqrt(n))
        best = int(np.argmin((qu + 1.01 * margin) / qp))
        return float(np.clip(qu[best] / qp[best], 0.01, 0.99))


#: Fewer rows of a kind than this say nothing about the prior.
LEAST_ROWS = 4


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0) -> float:
    """The share of positives among the unlabelled, by the best bin of a network that tells the two kinds apart."""
    if min(len(positive), len(unlabelled)) < LEAST_ROWS:
        return 0.5
    halves = Halves(positive, unlabelled, seed)
    return halves.prior(halves.bins(unlabelled[halves.others]))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 0) -> Network:
    """Non-negative risk: where the estimated risk of negatives is below zero, a step is taken against it."""
    every = np.concatenate((positive, unlabelled))
    net = Network(every.mean(axis=0), every.std(axis=0) + 0.05, prior, seed)
    if not len(positive) or not len(unlabelled):
        return net
    p, u, rng = net.scaled(positive), net.scaled(unlabelled), np.random.default_rng(seed)
    first, second = ([np.zeros_like(x) for x in net.p] for _ in range(2))
    t = 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(u)), max(1, len(u) // BATCH)):
            xu, xp = u[at], p[rng.integers(0, len(p), min(BATCH, len(p)))]
            (hp, fp), (hu, fu) = net.forward(xp), net.forward(xu)
            negative = _softplus(fu).mean() - prior * _softplus(fp).mean()
            gu, gp_minus, gp_plus = _sigmoid(fu) / len(fu), prior * _sigmoid(fp) / len(fp), -prior * _sigmoid(-fp) / len(fp)
            if negative >= 0:
                a, b = net.gradients(xu, hu, gu), net.gradients(xp, hp, gp_plus - gp_minus)
            else:
                a, b = net.gradients(xu, hu, -gu), net.gradients(xp, hp, gp_minus)
            t += 1
            for k, w in enumerate(net.p):
                g = a[k] + b[k] + (DECAY * w if w.ndim == 2 else 0)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w -= RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return net


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([features(x).tobytes() for x in b["text"].to_pylist()], pa.binary())], ["doc_id", "f"])


def _least(ids: DataFrame, n: int) -> DataFrame:
    return ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def _matrix(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Features of a row of each of these ids, of which there are at most FIT_ROWS, and the ids."""
    featured = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").mapInArrow(_featured, "doc_id long, f binary")
    found = sorted(featured.groupBy("doc_id").agg(F.min("f").alias("f")).collect())
    return np.frombuffer(b"".join(bytes(x.f) for x in found), np.float32).reshape(-1, N_FEATURES).astype(np.float64), [x.doc_id for x in found]


def _rows_of(b: pa.RecordBatch) -> np.ndarray:
    return np.array([features(t) for t in b["text"].to_pylist()], np.float64).reshape(-1, N_FEATURES)


def _binned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves, total = shared.value, 0
        for b in slices(batches):
            total = total + halves.bins(_rows_of(b))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.atleast_1d(total)[at], pa.int64())], ["bin", "n"])

    return run


def _prior(docs: DataFrame, positive: np.ndarray, unlabelled: np.ndarray, ids: list[int]) -> float:
    """estimated_prior over all of docs but the rows whose ids the first network is fitted on."""
    if min(len(positive), len(unlabelled)) < LEAST_ROWS:
        return 0.5
    halves, spark = Halves(positive, unlabelled), docs.sparkSession
    used = spark.createDataFrame([(ids[i],) for i in halves.used.tolist()], "doc_id long")
    others = docs.join(F.broadcast(used), "doc_id", "left_anti").select("text")  # at most FIT_ROWS ids
    bins = np.zeros(len(halves.cuts) + 1, np.int64)
    for x in others.mapInArrow(_binned(Shared(spark, halves)), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        bins[x.bin] = x.n
    return halves.prior(bins)


def _hidden(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in slices(batches):
            h = net.forward(net.scaled(_rows_of(b)))[0].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in h], pa.binary())], ["h"])

    return run


def sums(h: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows, the loss as negatives for each row of weights (bias last), and gradient and Hessian of the first one's."""
    h = np.concatenate((h, np.ones((len(h), 1))), axis=1)
    f = h @ weights.T
    s = _sigmoid(f[:, 0])
    return np.concatenate(([len(h)], _softplus(f).sum(axis=0), s @ h, ((h * (s * (1 - s))[:, None]).T @ h).ravel()))


def _summed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, total = shared.value, None
        for b in batches:
            if b.num_rows:
                one = sums(np.frombuffer(b"".join(b["h"].to_pylist()), np.float32).reshape(-1, HIDDEN).astype(np.float64), weights)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], ["i", "x"])

    return run


def solved(total: Callable[[np.ndarray], np.ndarray], positive: np.ndarray, prior: float, weights: np.ndarray) -> np.ndarray:
    """Output weights (bias last) of least risk, from ``weights`` where the risk of negatives is not below zero there, else from none.

    total: the ``sums`` over all unlabelled rows for some weights; positive: hidden values of the positives.
    """
    p = np.concatenate((positive, np.ones((len(positive), 1))), axis=1)

    def risks(tried: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Risk of each, infinite where that of negatives is below zero; gradient and Hessian at the first."""
        t, k = total(tried), len(tried)
        f = p @ tried.T
        negatives = t[1 : k + 1] / t[0] - prior * _softplus(f).mean(axis=0)
        risk = prior * _softplus(-f).mean(axis=0) + negatives + DECAY / 2 * (tried**2).sum(axis=1)
        m = p.shape[1]
        g = t[k + 1 : k + 1 + m] / t[0] - prior * p.mean(axis=0) + DECAY * tried[0]
        return np.where(negatives < 0, np.inf, risk), g, t[k + 1 + m :].reshape(m, m) / t[0] + DECAY * np.eye(m)

    none = np.zeros_like(weights)
    none[-1] = np.log(prior / (1 - prior))
    found, g, hessian = risks(np.stack((weights, none)))
    if np.isfinite(found[0]):
        w, risk = weights, found[0]
    else:
        w, risk = none, found[1]
        _, g, hessian = risks(w[None])
    for _ in range(STEPS):
        step = np.linalg.solve(hessian, g)
        tried = w - np.array(SHARES)[:, None] * step
        found, g, hessian = risks(tried)
        best = int(found.argmin())
        if not found[best] < risk - 1e-8:
            break
        w, risk = tried[best], found[best]
        if best:
            _, g, hessian = risks(w[None])
    return w


def _over_all(docs: DataFrame, net: Network, positive: np.ndarray) -> Network:
    """net with the output layer of least risk over all of docs."""
    spark = docs.sparkSession
    hidden = stored(docs.select("text").mapInArrow(_hidden(Shared(spark, net)), "h binary"), "hidden")

    def total(weights: np.ndarray) -> np.ndarray:
        rows = hidden.mapInArrow(_summed(Shared(spark, weights)), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
        return np.array([x.x for x in rows])

    h = net.forward(net.scaled(positive))[0]
    w = solved(total, h, net.prior, np.append(net.p[2], net.p[3]))
    net.p[2], net.p[3] = w[:-1], w[-1:]
    dropped(hidden)
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Network:
    """docs and labels: the rows of the training folds only."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    labels = labels.select(F.col("doc_id").cast("long"), F.col(label).alias("y")).where("doc_id IS NOT NULL AND y = 1")
    positive, _ = _matrix(docs, _least(labels.select("doc_id"), FIT_ROWS))
    unlabelled, ids = _matrix(docs, _least(docs.select("doc_id"), FIT_ROWS))
    if not len(positive) or not len(unlabelled):
        return Network(np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.5)
    return _over_all(docs, fit_pu(positive, unlabelled, _prior(docs, positive, unlabelled, ids)), positive)


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(net.score(_rows_of(b)), pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score; only the text is looked at."""
    shared = Shared(docs.sparkSession, net)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scored(shared), "doc_id long, score double")


def _held_out() -> Column:
    return fold("doc_id", FOLDS) == HELD_OUT


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    net = fit(docs.where(~_held_out()), labels.where(~_held_out()))
    return score(docs, net).select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
