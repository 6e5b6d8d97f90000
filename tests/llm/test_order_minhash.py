"""Operator 4 against a plain order MinHash, with nulls, repeats, long texts and empty tables."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from kmerloom.llm import order_minhash as om


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def xx(*values):
    """Spark's xxhash64: each value is hashed with the hash before as seed."""
    h = 42
    for v in values:
        h = h if v is None else xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True) if isinstance(v, int) else b"", h)
    return signed(h)


def xx_int(h, n):
    """One more value, an int, which Spark hashes as 4 bytes."""
    return signed(xxhash.xxh64_intdigest(n.to_bytes(4, "little", signed=True), h % 2**64))


def plain(text):
    w = [xx(x) for x in re.split(r"[ \t\n\x0b\f\r]+", text or "") if x]
    grams = [xx(*w[i : i + om.K]) for i in range(len(w) - om.K + 1)] if len(w) >= om.K else [xx(*w)] if w else []
    seen, found = {}, {}
    for place, g in enumerate(grams):
        h = g >> om.PLACE_BITS
        occurrence = seen[h] = seen.get(h, -1) + 1
        p = xx_int(xx(h), occurrence) % 2**64
        found.setdefault(p >> 59, []).append((p >> om.PLACE_BITS, place, g))
    out = []
    for sketch, all_ in sorted(found.items()):
        chosen = sorted(all_, key=lambda x: ((x[0] - 2 ** (64 - om.PLACE_BITS) if x[0] >= 2 ** (63 - om.PLACE_BITS) else x[0]), x[1]))[: om.SELECTED]
        tuple_ = [g for _, _, g in sorted(chosen, key=lambda x: x[1])]
        out.append((sketch, xx(*tuple_, *[None] * (om.SELECTED - len(tuple_))) % 2**32))
    return out


def like(a, b):
    filled = {x[0] for x in a} | {x[0] for x in b}
    return len(set(a) & set(b)) / len(filled) if filled else 1.0


TEXTS = [None, "", " \n ", "one", "two words", "a b c", "a b c d", "b a c d", "x " * 40, "Ünï çødé 日本語 text with some more words in it", "a b c a b c a b c a b c d e a b c", "one", " ".join(str(i * i % 977) for i in range(9000)), "the\nlast\tone here now"]


def check(df, rows, nulls=()):
    got = {x.doc_id: x for x in om.compared(df).collect()}
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after, x = text or "", after or "", got[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert x.n_chars == len(text) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        shown = "".join(f"{(s << 32) | h:010x}" for s, h in plain(text))
        assert x.fingerprint == shown and x.edited_fingerprint == "".join(f"{(s << 32) | h:010x}" for s, h in plain(edited))
        assert x.near_edited == pytest.approx(like(plain(text), plain(edited))) and x.near_next == pytest.approx(like(plain(text), plain(after)))


def test_against_brute_force(spark):
    rows = [(5 * i % 14, t) for i, t in enumerate(TEXTS)] + [(None, "no id at all")]
    df = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, sketches string").repartition(3)
    check(df, rows)


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(om, "BUCKET_BYTES", 40)
    monkeypatch.setattr(om, "FANOUT", 3)
    rows = [(3 * i, " ".join(str(j * i % 11) for j in range(i % 9))) for i in range(100)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_alone_repeated_and_empty(spark):
    check(spark.createDataFrame([(1, "just me and nobody else")], "doc_id long, text string"), [(1, "just me and nobody else")])
    twice = om.compared(spark.createDataFrame([(1, "a b c d e f")] * 2, "doc_id long, text string")).collect()
    assert len(twice) == 2 and {x.near_next for x in twice} == {1.0}
    assert om.compared(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_order_matters(spark):
    w = [str(i) for i in range(600)]
    rows = [(1, " ".join(w)), (2, " ".join(w[300:] + w[:300])), (3, " ".join(w[:590]))]
    got = {x.doc_id: x for x in om.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].near_next < 0.9
    assert got[3].near_next > 0.85  # a few words fewer than document 1


def test_plan_is_native(spark):
    df = om.compared(spark.createDataFrame([(1, "a")], "doc_id long, text string").where(F.col("doc_id") > 0))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
