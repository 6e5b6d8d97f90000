"""Document fingerprints by order MinHash, in DataFrame functions only.

A text's words give k-mers of ``K`` words (the whole text if it has fewer). A k-mer's
occurrence number is how often it came before; the pair of both is hashed to a
priority. The priority's top bits choose one of ``SKETCHES`` sketches; each sketch
selects its ``SELECTED`` least priorities, puts those k-mers back in text order,
and hashes the tuple. One hash a k-mer thus serves all sketches. Likeness is the
share of sketches, among those that either text fills, with equal tuples. As tuples
hold the order of k-mers and repeats count, it follows edit distance where a plain
MinHash follows sets.

A k-mer's place is kept in ``PLACE_BITS`` bits of a long beside its hash, so that
sorting longs does the selection. Occurrence numbers need runs in sorted arrays
only: firsts have number 0, and for the repeats a prefix maximum by doubling finds
where their run starts.

Defined cases: null text is empty, and texts without words have the empty
fingerprint, of likeness 1 to each other and 0 to any other; null doc_ids come first;
rows of equal doc_id are ordered by their texts' hash; the only row is its
own next document; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

K = 3
SKETCHES = 32
SELECTED = 2
#: Bits of a place: no array of longs that Spark can hold is longer than 2 ** 28.
PLACE_BITS = 28
#: Bytes of text that one bucket of doc_ids is meant to hold.
BUCKET_BYTES = 4 << 20
#: A level of the search for a doc_id's bucket compares so many bounds.
FANOUT = 64


def _with_sketches(df: DataFrame, text: str, out: str) -> DataFrame:
    """Column out: an array of longs, sketch number above 32 bits of its tuple's hash, by sketch."""
    low = F.lit((1 << PLACE_BITS) - 1)
    bits = int(math.log2(SKETCHES))
    key = lambda x: F.shiftright(x, PLACE_BITS)
    sketch = lambda x: F.shiftrightunsigned(x, 64 - bits)
    packed = lambda h, place: h.bitwiseAND(F.bitwise_not(low.cast("long"))).bitwiseOR(place)

    words = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    grams = F.transform(F.slice("_h", 1, F.greatest(F.size("_h") - (K - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get("_h", i + j) for j in range(1, K)]))
    whole = F.when(F.size("_h") == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64("_h")))
    df = df.withColumn("_k", F.when(F.size("_h") < K, whole).otherwise(grams))
    df = df.withColumn("_s", F.sort_array(F.transform("_k", lambda x, i: packed(x, i.cast("long").bitwiseAND(low)))))
    df = df.withColumn("_r", F.filter("_s", lambda x, i: (i > 0) & (key(x) == key(F.get("_s", i - 1)))))
    start = F.transform("_r", lambda x, i: F.when((i > 0) & (key(x) == key(F.get("_r", i - 1))), 0).otherwise(i))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size("_r") + F.lit(1))).cast("int"))
    running = F.aggregate(rounds, start, lambda a, k: F.transform(a, lambda x, i: F.greatest(x, F.get(a, i - F.call_function("shiftleft", F.lit(1), k)))))
    numbers = F.transform(running, lambda first, i: i - first + 1)
    df = df.withColumn("_n", F.when(F.size("_r") > 0, numbers).otherwise(F.array().cast("array<int>")))
    firsts = F.transform(F.filter("_s", lambda x, i: (i == 0) | (key(x) != key(F.get("_s", i - 1)))), lambda x: packed(F.xxhash64(key(x), F.lit(0)), x.bitwiseAND(low)))
    # zipped, as the optimizer would copy a column that a lambda names once into it, to be computed for every element
    repeats = F.zip_with("_r", "_n", lambda x, n: packed(F.xxhash64(key(x), n), x.bitwiseAND(low)))
    df = df.withColumn("_c", F.sort_array(F.concat(firsts, repeats)))
    chosen = F.filter("_c", lambda x, i: (i < SELECTED) | (sketch(x) != sketch(F.get("_c", i - SELECTED))))
    df = df.withColumn("_t", F.sort_array(F.transform(chosen, lambda x: F.call_function("shiftleft", sketch(x), F.lit(PLACE_BITS)).bitwiseOR(x.bitwiseAND(low)))))

    def of_sketch(i: Column, j: int) -> Column:
        x = F.get("_t", i + j)
        return F.when(key(x) == key(F.get("_t", i)), F.get("_k", x.bitwiseAND(low).cast("int")))

    tuples = F.transform("_t", lambda x, i: F.when((i == 0) | (key(x) != key(F.get("_t", i - 1))), F.call_function("shiftleft", key(x), F.lit(32)).bitwiseOR(F.xxhash64(*[of_sketch(i, j) for j in range(SELECTED)]).bitwiseAND(F.lit(0xFFFFFFFF)))))
    return df.withColumn(out, F.filter(tuples, lambda x: x.isNotNull())).drop("_h", "_k", "_s", "_r", "_n", "_c", "_t")


def fingerprint(sketches: str | Column) -> Column:
    """Ten hexadecimal digits a sketch: its number and its hash."""
    return F.array_join(F.transform(sketches, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def likeness(a: str, b: str) -> Column:
    number = lambda c: F.transform(c, lambda x: F.shiftright(x, 32))
    filled = F.size(F.array_union(number(a), number(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def _bounds(docs: DataFrame) -> tuple[int | None, list[int]]:
    """The least doc_id and doc_ids above it that cut the table into buckets of about BUCKET_BYTES."""
    size, least = docs.agg(F.sum(F.octet_length("text")), F.min("doc_id")).first()
    n = math.ceil((size or 0) / BUCKET_BYTES)
    if n < 2 or least is None:
        return least, []
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * n)).alias("b")).first().b
    return least, sorted({x for x in found if x > least})


def _bucket(doc_id: Column, bounds: list[int], base: int = 0) -> Column:
    """base and how many bounds are at most doc_id; null is below all."""
    if len(bounds) <= FANOUT:
        return F.lit(base) + (F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda b: b <= doc_id)) if bounds else F.lit(0))
    step, out = math.ceil(len(bounds) / FANOUT), F
    for i in reversed(range(0, len(bounds), step)):
        out = out.when(doc_id >= bounds[i], _bucket(doc_id, bounds[i + 1 : i + step], base + i + 1))
    return out.otherwise(base)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited (text), sketches and edited_sketches, next_sketches for each row.

    Rows are dealt out once, by ranges of doc_id; the first row of each range is also
    given to the range before, so each row meets its successor without a global sort.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text").cast("string")).alias("text"))
    least, bounds = _bounds(docs)
    order = F.struct(F.col("doc_id").isNotNull().alias("a"), "doc_id", F.xxhash64("text").alias("b"), F.col("text").alias("c"))
    held = docs.withColumn("bucket", _bucket(F.col("doc_id"), bounds))
    edge = F.col("doc_id").isNull() | F.col("doc_id").isin([*bounds, *([least] if least is not None else [])])
    firsts = held.where(edge).groupBy("bucket").agg(F.min(order).alias("f")).select(F.pmod(F.col("bucket") - 1, F.lit(len(bounds) + 1)).alias("bucket"), "f.doc_id", F.col("f.c").alias("text"), F.lit(True).alias("guest"))
    rows = held.withColumn("guest", F.lit(False)).unionByName(firsts).withColumn("tie", F.xxhash64("text"))
    by = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "tie")
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) AS INT))"), F.substring(F.coalesce(F.lead("text").over(by), F.lit("")), F.lit(1), half))
    rows = _with_sketches(_with_sketches(rows.withColumn("edited", edited), "text", "sketches"), "edited", "edited_sketches")
    return rows.withColumn("next_sketches", F.lead("sketches").over(by)).where(~F.col("guest")).drop("guest", "bucket", "tie")


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and their likenesses."""
    return fingerprints(docs).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("sketches").alias("fingerprint"), fingerprint("edited_sketches").alias("edited_fingerprint"),
        likeness("sketches", "edited_sketches").alias("near_edited"), likeness("sketches", "next_sketches").alias("near_next"),
    )
