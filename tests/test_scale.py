"""Work that grows with the input, not with its square; and plans that move what a query matches, not the corpus."""

import itertools
import os
import random
import time

import pytest

from kmerloom import registry
from kmerloom.functions import text as fmt
from kmerloom.functions.alphabet import DNA, DNA5, DNA_CASE, PROTEIN
from kmerloom.functions.kmers import code, explode_kmers
from kmerloom.plans import query as q

DATA = "/root/testdata/sf0.001"


def score(bits: str, k: int) -> int:
    """The mask's score as the SQL has it."""
    eroded = "".join("0" if "0" in bits[i : i + 3] else "1" for i in range(len(bits)))
    runs = [(c, len(list(g))) for c, g in itertools.groupby(eroded)]
    runs = [(c, n + (i < len(runs) - 1)) for i, (c, n) in enumerate(runs)]
    ones = sum(n for c, n in runs if c == "1")
    zeros = sum(n - 4 * (max(n - (k + 3) + 1, n / (k + 3)) * 0.05 + n / (k + 3)) for c, n in runs if c == "0")
    return int(max((ones + zeros) * (len(bits) + k - 1) / len(bits), 0)) if ones else 0


def test_scores_of_long_masks(spark):
    long = "1110" * 40_000 + "0" * 30 + "1" * 7
    masks = [long, "1110111", "0110111100010", "10101011", "1", "0" * 40 + "111", "1111" * 9 + "0" * 20 + "1"]
    began = time.time()
    got = spark.createDataFrame(list(enumerate(masks)), "i int, x string").select("i", fmt.mask_score("x", 12).alias("s")).collect()
    assert [x.s for x in sorted(got)] == [score(m, 12) for m in masks]
    assert time.time() - began < 30  # runs were found anew for each run


@pytest.mark.parametrize("alphabet,k", [(PROTEIN, 12), (PROTEIN, 3), (DNA, 5), (DNA5, 7), (DNA_CASE, 4), (DNA, 1)])
def test_wanted_kmers_are_found_as_by_exploding(spark, monkeypatch, alphabet, k):
    from kmerloom.functions import scan

    monkeypatch.setattr(scan, "STEP", 50)  # windows over the ends of steps and texts
    r = random.Random(k)
    texts = [None, "", "A" * k, "".join(r.choices("ACGT", k=333)), "".join(r.choices("acgtuUN xé😀#", k=400)), *("".join(r.choices("ACGTUacgn\n", k=r.randint(0, 90))) for _ in range(30))]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    every = explode_kmers(df, "seq", k, ["seq_id"], alphabet).withColumn("kmer", code("kmer", alphabet)).collect()
    wanted = sorted({x.kmer for x in every})[::2]
    got = scan.find_kmers(df, "seq", k, ["seq_id"], alphabet, [*wanted, alphabet_end := len(alphabet.letters) ** k - 1])
    assert sorted(got.collect()) == sorted(x for x in every if x.kmer in {*wanted, alphabet_end})
    assert scan.find_kmers(df, "seq", k, ["seq_id"], alphabet, []).count() == 0


@pytest.mark.parametrize("mode", q.MODES)
def test_few_queries_and_many_queries_agree(spark, monkeypatch, mode):
    r = random.Random(3)
    texts = ["".join(r.choices("ABC ", k=200)) for _ in range(6)]
    df = spark.createDataFrame([(i % 4, f"s{i % 3}", t) for i, t in enumerate(texts)], "seq_id long, label string, seq string")
    asked = spark.createDataFrame([(0, texts[0][20:90]), (1, texts[4][:50] + "zz" + texts[2][:60]), (2, "A")], "query_id long, seq string")
    rows = lambda d: sorted(map(tuple, d.collect()))
    few, batches = rows(q.query(q.Index(4, sequences=df), asked, mode, 0.3)), rows(q.in_batches(q.Index(4, sequences=df), asked, mode, letters=40, discovery_fraction=0.3))
    monkeypatch.setattr(q, "FEW_WINDOWS", 0)
    assert few == batches == rows(q.query(q.Index(4, sequences=df), asked, mode, 0.3)) and few


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_queries_store_no_index_of_the_corpus(spark):
    registry._STORED.clear()
    for name in ("q_matches", "q_coords", "q_cth", "q_batch"):
        registry.QUERIES[name](spark, DATA).count()
    assert not registry._STORED


@pytest.mark.parametrize("alphabet,k", [(PROTEIN, 3), (PROTEIN, 12), (DNA, 5), (DNA, 12), (DNA5, 7), (DNA, 1)])
def test_kmers_counted_in_tasks_are_those_exploded(spark, monkeypatch, alphabet, k):
    from pyspark.sql import functions as F

    from kmerloom.functions import scan

    monkeypatch.setattr(scan, "STEP", 50)
    monkeypatch.setattr(scan, "KEYS", 1)
    r = random.Random(k)
    texts = [None, "", "A" * k, "C" * (k - 1), "".join(r.choices("acgtuUN xé😀#", k=400)), *("".join(r.choices("ACGTUacgn\n", k=r.randint(0, 90))) for _ in range(30))]
    df = spark.createDataFrame([(i % 7, [None, "a", "b"][i % 3], t) for i, t in enumerate(texts)], "seq_id long, label string, seq string")
    want = explode_kmers(df, "seq", k, ["label"], alphabet).groupBy("label", "kmer").count().collect()
    got = scan.count_kmers(df, "seq", k, ["label"], alphabet).groupBy("label", "kmer").agg(F.sum("n")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
    if alphabet is PROTEIN:  # rows with the same seq_id are one
        each = explode_kmers(df, "seq", k, ["seq_id"]).groupBy("seq_id").agg(F.count("*"), F.count_distinct("kmer"), F.min("kmer"), F.max("kmer"), F.max("pos"))
        assert sorted(map(tuple, scan.summaries(df, k, alphabet).collect())) == sorted(map(tuple, each.collect()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_plans_do_not_explode_the_corpus(spark):
    for df in (registry.QUERIES["fn_kmers"](spark, DATA), registry.small_anno(spark, DATA), registry.small_counts(spark, DATA), registry.small_graph(spark, DATA).kmers):
        assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString() and df.count()


def test_nothing_is_gathered_for_whole_queries(spark, monkeypatch):
    """Where a seed is all of a query, no neighbours are looked up; a query with a gap is extended as before."""
    from kmerloom.operators import align, annotation
    from kmerloom.operators.graph import KmerGraph

    rows = []
    monkeypatch.setattr(align, "stored", lambda df, name, f=align.stored: (out := f(df, name), rows.append((name, out.count())))[0])
    df = spark.createDataFrame([(0, "A", "ACGGTCATTGAC"), (1, "B", "GGTCATTG")], "seq_id long, label string, seq string")
    g, anno = KmerGraph.build(df, 4, DNA), annotation.annotate(df, 4, alphabet=DNA)
    ask = lambda *seqs: spark.createDataFrame(list(enumerate(seqs)), "query_id long, seq string")
    got = align.align(g, ask("GGTCATTG", "TCATT"), anno=anno, min_match=1.0).collect()
    assert sorted((x.query_id, x.label, x.sequence, x.cigar) for x in got) == [(0, "A", "GGTCATTG", "8="), (0, "B", "GGTCATTG", "8="), (1, "A", "TCATT", "5="), (1, "B", "TCATT", "5=")]
    assert not sum(n for name, n in rows if name in ("align-near", "align-front", "align-done"))
    both = align.align(g, ask("GGTCATTG", "ACGGTCTTTGAC"), anno=anno).collect()
    assert ("A", "ACGGTCATTGAC") in {(x.label, x.sequence) for x in both if x.query_id == 1} and sum(x.query_id == 0 for x in both) == 2


def test_texts_are_not_copied_for_each_hit():
    """9,000 hits in a text of 9,000 letters took 81 MB of copies along."""
    import numpy as np
    import pyarrow as pa

    from kmerloom.functions import scan

    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array(["ABC" * 3_000])], ["seq_id", "seq"])
    wanted = np.unique([sum((ord(c) - 65) * 26 ** (11 - i) for i, c in enumerate(("ABC" * 5)[j : j + 12])) for j in range(3)])
    before = pa.total_allocated_bytes()
    sizes = [(x.num_rows, pa.total_allocated_bytes() - before) for x in scan._found(12, PROTEIN, wanted, 1)(iter([batch]))]
    assert sum(n for n, _ in sizes) == 8_989 and max(n for _, n in sizes) < 4 << 20


def test_scans_read_files_in_small_parts(spark, tmp_path):
    from kmerloom.plans import storage

    spark.range(2_000_000).selectExpr("id", "uuid() AS text").coalesce(1).write.option("parquet.block.size", 1 << 20).parquet(str(tmp_path / "t"))
    name, n = "spark.sql.files.maxPartitionBytes", lambda: spark.read.parquet(str(tmp_path / "t")).rdd.getNumPartitions()
    before = spark.conf.get(name), n()
    with pytest.raises(KeyError), storage.fine_splits(spark):
        assert spark.conf.get(name) == f"{storage.SPLIT_BYTES}b" and n() >= before[1]
        raise KeyError
    assert (spark.conf.get(name), n()) == before
