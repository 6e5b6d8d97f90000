"""Small cases with known answers, brute force for paths, and the readers and writers."""

import gzip
import random
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kmerloom import registry
from kmerloom.functions import cigar as cg
from kmerloom.functions import text as fmt
from kmerloom.functions.alphabet import DNA, DNA5, DNA_CASE, PROTEIN, revcomp
from kmerloom.functions.kmers import explode_kmers
from kmerloom.operators import align, annotation, clean, columns, differential, paths, stats, taxonomy
from kmerloom.operators.graph import KmerGraph
from kmerloom.plans import query as q
from kmerloom.plans.api import BadRequest, Service, mode_of
from kmerloom.plans.server import Client, Clients, serve
from kmerloom.plans.workflow import build_index
from kmerloom.sources import readers, writers
from kmerloom.streaming import incremental

# Three short sequences and a query, with the counts that they are known to give.
THREE = [("seq1", "TATCGATC"), ("seq2", "GTATCGATCGATCGATCG"), ("seq3", "ATCGATCG")]
ASKED = "TATCGATCGATCGATCG"


def seqs(spark, *texts):
    return spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(texts)], "seq_id long, label string, seq string")


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression.alias("y")).first().y


@pytest.fixture(scope="module")
def three(spark):
    df = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(THREE)], "seq_id long, label string, seq string")
    return q.Index(5, DNA, sequences=df), spark.createDataFrame([(0, ASKED)], "query_id long, seq string")


def test_six_modes(three):
    index, asked = three
    rows = lambda mode, f=0.0, **o: {x.label: x for x in q.query(index, asked, mode, f, **o).collect()}
    assert {k: x.matches for k, x in rows("matches").items()} == {"seq1": 10, "seq2": 13, "seq3": 12}
    assert {k: x.total for k, x in rows("counts_sum").items()} == {"seq1": 10, "seq2": 37, "seq3": 12}
    assert {k: x.abundances for k, x in rows("counts").items()} == {"seq1": "0-3=1:5-7=1:9-11=1", "seq2": "0=1:1-12=3", "seq3": "1-12=1"}
    assert {k: x.coords for k, x in rows("coords").items()} == {"seq1": "0-0-3:5-1-3:9-1-3", "seq2": "1-10-13:1-6-13:9-2-5:5-2-9:0-1-13", "seq3": "1-0-3:5-0-3:9-0-3"}
    assert {k: (x["mask"], x.score) for k, x in rows("signature").items()} == {"seq1": ("x4o1x3o1x3o1", 15), "seq2": ("x13", 17), "seq3": ("o1x12", 16)}
    assert set(rows("matches", top_n=1)) == {"seq2"} and set(rows("matches", top_n=2)) == {"seq2", "seq3"} and set(rows("matches", 1.0)) == {"seq2"}
    assert len(rows("labels", top_n=1)) == 3
    with pytest.raises(ValueError, match="mode"):
        q.query(index, asked, "nothing")


def test_headers_replace_labels(spark):
    df = spark.createDataFrame([(i, "f", n, s) for i, (n, s) in enumerate(THREE)], "seq_id long, label string, name string, seq string")
    headers = annotation.header_index(df.withColumnRenamed("label", "file"), 5)
    got = q.by_headers(q.Index(5, DNA, sequences=df), spark.createDataFrame([(0, ASKED)], "query_id long, seq string"), headers, 0.0).collect()
    assert {x.header: x.matches for x in got} == {"seq1": 10, "seq2": 13, "seq3": 12}


def test_masks(spark):
    assert one(spark, "11100110", fmt.mask_rle("x")) == "x3o2x2o1" and one(spark, "0" * 8, fmt.mask_rle("x")) == "o8" and one(spark, "", fmt.mask_rle("x")) == ""
    assert one(spark, "1" * 67, fmt.mask_score("x", 31)) == 97 and one(spark, "000", fmt.mask_score("x", 31)) == 0 and one(spark, "", fmt.mask_score("x", 31)) == 0


def test_coordinate_ranges(spark):
    for coords, want in (([[1, 2, 3], [2, 3, 4]], "0-1-2:0-2-3:0-3-4"), ([[1, 2, 3], [3, 4, 5]], "0-1:0-2-3:0-3-4:1-5"), ([[1, 3, 5]], "0-1:0-3:0-5")):
        df = spark.createDataFrame([(0, p, c) for p, cs in enumerate(coords) for c in cs], "g int, pos long, coord long")
        assert fmt.coordinate_ranges(df, ["g"], "pos", "coord").first().coords == want


def test_letters(spark):
    assert one(spark, "acgtNuRx", DNA.normalise("x")) == "ACGT#T##" and one(spark, "acgN*", DNA5.normalise("x")) == "ACGNN" and one(spark, "aß1Z", PROTEIN.normalise("x")) == "AXXZ" and one(spark, "acGRu", DNA_CASE.normalise("x")) == "acGNt"
    assert one(spark, "AACG", DNA.reverse_complement("x")) == "CGTT" and one(spark, "ARn", revcomp("x")) == "nYT"
    with pytest.raises(ValueError, match="complement"):
        PROTEIN.reverse_complement("x")


def test_kmers_against_brute_force(spark):
    r = random.Random(1)
    texts = ["", "ACG", "ACGNACGT", *("".join(r.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=n)) for n in (255, 256, 257, 300, 1000))]
    for k in (3, 7):
        got = Counter((x.seq_id, x.pos, x.kmer) for x in explode_kmers(seqs(spark, *texts), "seq", k, ["seq_id"], DNA).collect())
        assert got == Counter((i, p, t[p : p + k]) for i, t in enumerate(texts) for p in range(len(t) - k + 1) if "N" not in t[p : p + k])


def test_graph_sets(spark):
    a, b = KmerGraph.build(seqs(spark, "ACGTACG"), 3, DNA), KmerGraph.build(seqs(spark, "CGTT"), 3, DNA)
    assert {x.kmer: x.weight for x in a.merge(b).kmers.collect()} == {"ACG": 2, "CGT": 2, "GTA": 1, "TAC": 1, "GTT": 1}
    assert not a.equals(b) and a.equals(KmerGraph.build(seqs(spark, "ACGTACG"), 3, DNA))
    assert {x.kmer: x.weight for x in KmerGraph.build(seqs(spark, "A" * 300), 3, DNA, width=8).kmers.collect()} == {"AAA": 255}
    assert {x.kmer for x in KmerGraph.build(seqs(spark, "ACGTT"), 3, DNA, "canonical").both_strands().collect()} == {"ACG", "CGT", "AAC", "GTT"}
    with pytest.raises(ValueError, match="agree"):
        a.merge(KmerGraph.build(seqs(spark, "ACGT"), 4, DNA))


def plain_unitigs(kmers):
    out, into = {}, {}
    for x in kmers:
        out.setdefault(x[:-1], []).append(x)
        into.setdefault(x[1:], []).append(x)
    follow = {u: out[u[1:]][0] for u in kmers if len(out.get(u[1:], [])) == 1 and len(into[u[1:]]) == 1 and out[u[1:]][0] != u}
    back, found, left = {v: u for u, v in follow.items()}, [], set(kmers)
    for head in sorted(kmers):
        if head not in back:
            path = [head]
            while path[-1] in follow:
                path.append(follow[path[-1]])
            found.append(path)
            left -= set(path)
    while left:
        path = [min(left)]
        while follow[path[-1]] != path[0]:
            path.append(follow[path[-1]])
        found.append(path)
        left -= set(path)
    return Counter(p[0] + "".join(x[-1] for x in p[1:]) for p in found)


def test_paths(spark):
    r = random.Random(2)
    for texts in (["ACGTTGCA"], ["ACACACAC", "GGGGG"], ["ACGGTCACGGT", "TTTACG"], ["".join(r.choices("ACGT", k=200)) for _ in range(2)]):
        g = KmerGraph.build(seqs(spark, *texts), 4, DNA)
        kmers = sorted(x.kmer for x in g.kmers.collect())
        assert Counter(x.seq for x in paths.unitigs(g).collect()) == plain_unitigs(kmers)
        spelled = [x.seq for x in paths.contigs(g).collect()]
        assert sorted(s[i : i + 4] for s in spelled for i in range(len(s) - 3)) == kmers


def test_gfa_and_adjacency(spark):
    g = KmerGraph.build(seqs(spark, "ACGTC", "ACGTG"), 4, DNA)  # ACGT forks to CGTC and CGTG
    lines = [x.line for x in paths.gfa(g).collect()]
    assert sorted(lines) == sorted(["H\tVN:Z:1.0", "S\t1\tACGT", "S\t2\tCGTC", "S\t3\tCGTG", "L\t1\t+\t2\t+\t3M", "L\t1\t+\t3\t+\t3M"])
    assert {x.kmer: x.successors for x in paths.adjacency(g).collect()} == {"ACGT": "CGTC,CGTG", "CGTC": "", "CGTG": ""}
    merged = writers.merge_gfa(spark.createDataFrame([("S\t1\tA",)], "line string"), spark.createDataFrame([("P\tx\t1+\t3M",)], "line string"))
    assert [x.line for x in merged.collect()] == ["S\t1\tA", "P\t1\t1+\t3M"]


def test_cleaning(spark):
    assert clean.pick_threshold({}) == -1 and clean.pick_threshold({1: 1000, 2: 0, 9: 5}) == -1
    errors = {1: 100_000, 2: 5_000, 3: 400, 4: 50, **{i: 2000 for i in range(10, 40)}}
    assert 3 <= clean.pick_threshold(errors) <= 10
    g = KmerGraph(spark.createDataFrame([("AAC", 1), ("ACG", 5), ("CGT", 9)], "kmer string, weight long"), 3, DNA)
    assert {x.kmer for x in clean.count_filter(g, 2, 5).kmers.collect()} == {"ACG"}
    assert {x.kmer for x in clean.clean(g, min_median=6).kmers.collect()} == set() and clean.clean(g, min_median=3).kmers.count() == 3
    assert clean.clean(g, tip_size=4).kmers.count() == 0 and clean.clean(g, tip_size=3).kmers.count() == 3
    assert sorted((x["slice"], x.weight) for x in clean.count_slices(g, [0, 0.5, 1]).collect()) == [(0, 1), (1, 5), (1, 9)]
    with pytest.raises(ValueError, match="threshold"):
        clean.threshold(g)


def test_differential(spark):
    k = 5
    rows = [("A", "T" + "A" * 4 + "T" * 20), ("B", "TAAAAC"), ("C", "TAAAAC"), ("D", "TAAAAA"), ("E", "TAAAAG")]
    df = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(rows)], "seq_id long, label string, seq string")
    anno = annotation.annotate(df, k, alphabet=DNA)
    rule = differential.Rule("x", ["B", "C"], ["A"])
    assert {x.kmer for x in differential.by_node(anno, rule).collect()} == {"AAAAC"}
    rules = differential.read_rules('{"groups": [{"shared_labels": ["s"], "experiments": [{"name": "n", "in": ["a"], "out": ["b"], "in_min_fraction": 0.5,},]}, {"experiments": [{"name": "m", "in": ["c"]}]}]}')
    assert [(x.name, x.in_min_fraction, x.out_max_fraction, x.shared_labels) for x in rules] == [("n", 0.5, 0.0, ["s"]), ("m", 1.0, 0.0, ["s"])]
    with pytest.raises(ValueError, match="in"):
        differential.read_rules('{"groups": [{"experiments": [{"name": "n"}]}]}')


def test_columns(spark):
    anno = spark.createDataFrame([("k1", "a", 1), ("k1", "b", 3), ("k2", "a", 2), ("k3", "b", 9), ("k3", "c", 1)], "kmer string, label string, count long")
    assert {(x.kmer, x.n_labels, x.total) for x in columns.aggregate(anno, 2).collect()} == {("k1", 2, 4), ("k3", 2, 10)}
    assert {(x.kmer, x.total) for x in columns.aggregate(anno, 0, max_value=1).collect()} == {("k1", 1), ("k3", 1)}
    assert columns.bounds(10, 0.33, 0.66, fraction=True) == (4, 6) and columns.bounds(10, 0) == (1, 10)
    assert columns.greedy_match([("a", "b", 1.0), ("b", "c", 5.0)], ["a", "b", "c", "d"]) == [("b", "c"), ("a", "d")]
    link = columns.linkage(anno)
    assert len(link) == 2 and link[-1][2] == 3 and link[0][:2] == (0, 1)
    assert {(x.labels, x.n_kmers) for x in columns.row_classes(anno).collect()} == {("a,b", 1), ("a", 1), ("b,c", 1)}
    renamed = annotation.rename(anno, spark.createDataFrame([("b", "a")], "old string, new string"))
    assert {(x.kmer, x.label, x["count"]) for x in renamed.collect()} == {("k1", "a", 4), ("k2", "a", 2), ("k3", "a", 9), ("k3", "c", 1)}
    assert stats.annotation_stats(anno).first().density == pytest.approx(5 / 9)


def test_cigar():
    s = cg.Scoring()
    assert cg.parse("2S3=1X1D2I") == [("S", 2), ("=", 3), ("X", 1), ("D", 1), ("I", 2)] and cg.show([("=", 1), ("=", 2), ("X", 0)]) == "3="
    assert cg.is_valid(cg.parse("2=1X1D1I1="), "ACGTA", "ACTCA") and not cg.is_valid(cg.parse("3="), "ACG", "ACT")
    assert s.score("ACG", "ACG", "3=") == 16 and s.score("ACT", "ACG", "2=1X") == 11 and s.score("ACG", "AC", "2=1D") == 8
    assert cg.read_matrix("# x\n   A  R\nA  4 -1\nR -1  5\n") == {("A", "A"): 4, ("A", "R"): -1, ("R", "A"): -1, ("R", "R"): 5}
    with pytest.raises(ValueError, match="CIGAR"):
        cg.parse("3Q")
    assert cg.low_complexity("A" * 20) and not cg.low_complexity("ACGTTGCATCGGATCCATTGCAC")


def test_alignment(spark):
    path = "ACGGTCATTGACCTGATTCA"
    g = KmerGraph.build(seqs(spark, path), 5, DNA)
    cases = {"exact": path, "mismatch": path[:9] + "C" + path[10:], "deletion": path[:9] + path[10:], "insertion": path[:9] + "GG" + path[9:]}
    asked = spark.createDataFrame([(i, c) for i, c in enumerate(cases.values())], "query_id long, seq string")
    got = {x.query_id: x for x in align.align(g, asked, steps=25).collect()}
    nodes = {path[i : i + 5] for i in range(16)}
    for i, text in enumerate(cases.values()):
        assert align.valid(text, got[i].sequence, got[i].cigar, 5, nodes) and got[i].score == cg.Scoring().score(got[i].sequence, text, got[i].cigar)
    assert [got[i].score for i in range(4)] == [50, 45, 42, 42] and got[0].cigar == "20="
    both = align.align_both_strands(g, asked.where("query_id = 0").withColumn("seq", DNA.reverse_complement("seq")), steps=3).first()
    assert both.orientation == "-" and both.sequence == path
    assert align.align(g, spark.createDataFrame([(9, "TTTTTTTT")], "query_id long, seq string")).count() == 0


def test_alignment_goes_on_within_its_drop(spark):
    """Tails without an exact k-mer that are longer than k + 1 letters, at either end; by default no walk is cut."""
    r = random.Random(8)
    path = "".join(r.choices("ACGT", k=80))
    k = 7
    g = KmerGraph.build(seqs(spark, path), k, DNA)
    other = lambda s, places: "".join({"A": "C", "C": "A", "G": "T", "T": "G"}[c] if i in places else c for i, c in enumerate(s))
    asked = {0: other(path[20:60], {13, 19, 25, 31, 37}), 1: other(path[20:60], {2, 8, 14, 20, 26})}
    got = {x.query_id: x for x in align.align(g, spark.createDataFrame(list(asked.items()), "query_id long, seq string")).collect()}
    nodes = {path[i : i + k] for i in range(len(path) - k + 1)}
    for i, text in asked.items():
        whole = align.align_one(text, nodes, k, cg.Scoring(), [(p, p) for p in range(len(text) - k + 1) if text[p : p + k] in nodes])
        assert got[i].cigar.count("X") == 5 and got[i].sequence == path[20:60] and (got[i].score, got[i].matches) == (whole[1], 35)


def test_alignment_within_a_label(spark):
    """A path over both labels is no path of either; the best n hold for each label, within a share of the query's best."""
    left, right = "ACGGTCATTGACC", "TTGACCTGATTCA"
    df = spark.createDataFrame([(0, "A", left), (1, "B", right)], "seq_id long, label string, seq string")
    g, anno = KmerGraph.build(df, 5, DNA), annotation.annotate(df, 5, alphabet=DNA)
    text = left + right[6:]
    asked = spark.createDataFrame([(0, text), (1, "TTTTTTTT")], "query_id long, seq string")
    assert align.align(g, asked).first().cigar == "20="
    got = {x.label: x for x in align.align(g, asked, anno=anno).collect()}
    assert {k: (x.query_id, x.sequence, x.cigar, x.score) for k, x in got.items()} == {"A": (0, left, "13=7S", 31), "B": (0, right, "7S13=", 31)}
    assert {x.label for x in align.top(align.align(g, asked, anno=anno), 1).collect()} == {"A", "B"}
    only = align.align(g, spark.createDataFrame([(0, left)], "query_id long, seq string"), anno=anno)
    assert [x.label for x in align.top(only).collect()] == ["A"] and align.align(g, asked, anno=anno, min_match=0.9).count() == 0
    with pytest.raises(ValueError, match="basic"):
        align.align(KmerGraph.build(df, 5, DNA, "canonical"), asked, anno=anno)


@pytest.mark.parametrize("whole", [align.WHOLE, 0])
def test_registered_alignment_takes_every_pair_of_query_and_label(spark, tmp_path, monkeypatch, whole):
    """Pairs that hold a part of a query are extended and stay, not only those that hold all of it; equal names get rows each."""
    monkeypatch.setattr(align, "WHOLE", whole)
    names = [(1, "A", "small ring"), (2, "B", "small bolt"), (3, "B", "hot ring"), (4, "A", "small ring"), (5, "C", "widget"), (6, "C", "cog"), (7, "C", None)]
    spark.createDataFrame(names, "p_partkey long, p_brand string, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = registry.QUERIES["aln_labeled"](spark, str(tmp_path)).collect()
    assert sorted((x.query_id, x.label, x.sequence, x.cigar) for x in got) == [
        (1, "A", "SMALLXRING", "10="), (1, "B", "SMALLX", "6=4S"), (2, "A", "SMALLX", "6=4S"), (2, "B", "SMALLXBOLT", "10="),
        (3, "A", "XRING", "3S5="), (3, "B", "HOTXRING", "8="), (4, "A", "SMALLXRING", "10="), (4, "B", "SMALLX", "6=4S"), (5, "C", "WIDGET", "6="),
    ]


def test_trimmed_alignments():
    r = random.Random(4)
    for _ in range(300):
        ops = [("S", r.randint(0, 2))] + [(op, r.randint(1, 3)) for op in "=" + "".join(r.choices("=XID", k=r.randint(0, 5))) + "="] + [("S", r.randint(0, 2))]
        ops = cg.parse(cg.show([x for x in ops if x[1]]))
        query, reference = "", ""
        for op, n in ops:
            for _ in range(n):
                c = r.choice("ACGT")
                query += c * (op != "D")
                reference += (c if op != "X" else {"A": "C", "C": "A", "G": "T", "T": "G"}[c]) * (op not in "SI")
        front, back = r.randint(0, 4), r.randint(0, 4)
        cut, kept = cg.trimmed(ops, reference, front, back)
        assert cg.is_valid(cut, kept, query) and reference.find(kept) >= 0
        inner = [op for op, _ in cut if op != "S"]
        assert not inner or (inner[0] in "=X" and inner[-1] in "=X")
        assert cg.trimmed(ops, reference) == (ops, reference)
        flip = {"A": "T", "T": "A", "C": "G", "G": "C"}
        back_ops, back_ref = cg.turned(ops, reference, flip)
        assert cg.is_valid(back_ops, back_ref, "".join(flip[c] for c in reversed(query)))
    assert cg.trimmed([("=", 3), ("I", 2), ("=", 3)], "ACGTTA", 3) == ([("S", 5), ("=", 3)], "TTA")
    assert align.passed("ACGTA", "1S3=1X1=", 2) == {(1, "AC"), (2, "CG")}


def test_chain(spark):
    schema = "query_id long, label string, pos long, coord long, length long, query_length long"
    seeds = spark.createDataFrame([(0, "a", 0, 10, 5, 60), (0, "a", 8, 18, 5, 60), (0, "a", 3, 50, 4, 60)], schema)
    assert align.chain(seeds).first().asDict() == {"query_id": 0, "label": "a", "score": 10.0, "chain": "0@10+5,8@18+5"}
    gap = align.chain(spark.createDataFrame([(0, "a", 0, 10, 5, 60), (0, "a", 8, 21, 5, 60)], schema)).first()
    assert gap.score == pytest.approx(10 - 0.19 * 3 - 0.5 * 2) and gap.chain == "0@10+5,8@21+5"
    apart = align.chain(spark.createDataFrame([(0, "a", 0, 10, 5, 20), (0, "a", 8, 40, 5, 20)], schema)).first()
    assert apart.score == 5.0  # farther apart than the query is long


def test_protein_alignment(spark):
    g = KmerGraph.build(seqs(spark, "QWERTYIPASDFGHKLCVNM"), 4)
    got = {x.query_id: x for x in align.align(g, spark.createDataFrame([(0, "QWERTYIPASDFGHKLCVNM"), (1, "QWERTYIPAWDFGHKLCVNM")], "query_id long, seq string")).collect()}
    own = cg.protein_matrix()
    whole = sum(own[c, c] for c in "QWERTYIPASDFGHKLCVNM")
    assert (got[0].cigar, got[0].score) == ("20=", whole + 10) and (got[1].cigar, got[1].score) == ("9=1X10=", whole + 10 - own["S", "S"] + own["S", "W"])
    assert own["B", "N"] == 3 and own["X", "X"] == -1 and own["J", "J"] == 1 and all(own[a, b] == own[b, a] for a, b in own)
    with pytest.raises(ValueError, match="no score"):
        cg.Scoring().pair("A", "Q")


def test_fastq_forms(spark, tmp_path):
    forms = {"name": "@r1 x\nACG\n+r1 x\nIII\n@r2\nTT\n+r2\n@I\n", "crlf": "@r1 x\r\nACG\r\n+\r\nIII\r\n@r2\r\nTT\r\n+\r\n@I\r\n", "blank": "@r1 x\nACG\n+\nIII\n@r2\nTT\n+\n@I\n\n\n"}
    for name, text in forms.items():
        (tmp_path / f"{name}.fq").write_bytes(text.encode())
        assert sorted((x.seq_no, x.name, x.comment, x.seq) for x in readers.read_fastq(spark, str(tmp_path / f"{name}.fq")).collect()) == [(0, "r1", "x", "ACG"), (1, "r2", "", "TT")], name
    for name, text in {"short": "@r1\nACG\n+\nII\n", "cut": "@r1\nACG\n+\n", "mark": "r1\nACG\n+\nIII\n"}.items():
        (tmp_path / f"{name}.fq").write_text(text)
        with pytest.raises(Exception, match="malformed FASTQ"):
            readers.read_fastq(spark, str(tmp_path / f"{name}.fq")).collect()


def test_numbers_of_records_in_split_files(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        (tmp_path / "a.fa").write_text("".join(f">n{i}\n{'ACGT' * 5}\n" for i in range(200)))
        (tmp_path / "a.fq").write_text("".join(f"@n{i}\nACGT\n+\nIIII\n" for i in range(200)))
        for read in (readers.read_fasta, readers.read_fastq):
            name = str(tmp_path / ("a.fa" if read is readers.read_fasta else "a.fq"))
            assert sorted((x.seq_no, x.name) for x in read(spark, name).collect()) == [(i, f"n{i}") for i in range(200)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_coordinates_of_labels_with_equal_numbers(spark):
    df = spark.createDataFrame([("A", 0, "ACGT"), ("B", 0, "ACGT")], "label string, seq_id long, seq string")
    assert sorted((x.label, x.kmer, x.coords) for x in annotation.annotate_coords(df, 4, alphabet=DNA).collect()) == [("A", "ACGT", [0]), ("B", "ACGT", [0])]


def test_variants_of_several_files(spark, tmp_path):
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    (tmp_path / "a.vcf").write_text(head + "A\n1\t4\t.\tT\tG\t.\tPASS\tF;N=0;M=2\tGT\t0|1\n")
    (tmp_path / "b.vcf").write_text(head + "B\n1\t4\t.\tT\tC\t.\tPASS\tQ\tGT\t1|1\n")
    ref = spark.createDataFrame([("1", "ACGTACG")], "name string, seq string")
    got = readers.read_vcf(spark, [str(tmp_path / "a.vcf"), str(tmp_path / "b.vcf")], ref, 2, ["F", "N", "M"]).collect()
    assert {(x.seq, tuple(x.labels)) for x in got} == {("CGGAC", ("1", "F", "M", "A")), ("CGCAC", ("1", "B"))}


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x first ka:f:2.6\nACGT\nAC\n>y\r\nGGG\r\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@r1 c\nACG\n+\nIII\n@r2\nTTT\n+\nIII\n")
    rows = readers.read_sequences(spark, str(tmp_path / "a.fa")).orderBy("seq_no").collect()
    assert [(x.name, x.comment, x.seq) for x in rows] == [("x", "first ka:f:2.6", "ACGTAC"), ("y", "", "GGG")]
    assert [(x.seq_no, x.name, x.seq) for x in readers.read_sequences(spark, str(tmp_path / "b.fq.gz")).collect()] == [(0, "r1", "ACG"), (1, "r2", "TTT")]
    assert readers.read_many(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fq.gz")]).count() == 4
    assert [(x.name, x.seq) for x in readers.read_string(spark, ">q d\nAC\nGT\n>z\nA\n").collect()] == [("q", "ACGT"), ("z", "A")]
    assert [readers.file_format(x) for x in ("a.vcf.zst", "b.fastq.gz", "c.unknown", "d.parquet")] == ["vcf", "fastq", "fasta", "parquet"]
    assert one(spark, "L: km:f:0.2", readers.header_abundance("x")) == 1 and one(spark, "none", readers.header_abundance("x")) is None
    (tmp_path / "a.kmer_counts.gz").write_bytes(gzip.compress(struct.pack("<4I", 3, 7, 7, 9)))
    counts = readers.read_kmer_counts(spark, str(tmp_path / "a.kmer_counts.gz")).first()
    assert (counts.k, counts.counts) == (3, [7, 7, 9])
    runs = readers.count_runs(spark.createDataFrame([(0, "ACGTA", [7, 7, 9])], "seq_no long, seq string, counts array<long>"), 3).collect()
    assert {(x.piece, x.seq, x["count"]) for x in runs} == {(0, "ACGT", 7), (2, "GTA", 9)}
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n1\t4\t.\tT\tG,<CN2>\t.\tPASS\tFLAG;AF=1\tGT\t0|1\t2|0\n1\t5\t.\tA\tC\t.\tq10\t.\tGT\t0|1\t0|0\n")
    got = readers.read_vcf(spark, str(tmp_path / "v.vcf"), spark.createDataFrame([("1", "ACGTACG")], "name string, seq string"), 3).collect()
    assert {(x.seq, tuple(x.labels)) for x in got} == {("ACGGACG", ("1", "FLAG", "A")), ("ACGTTACG", ("1", "FLAG", "B"))}
    (tmp_path / "n.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tkingdom\t|\n3\t|\t2\t|\tgenus\t|\n4\t|\t1\t|\tgenus\t|\n")
    closure = taxonomy.ancestors(readers.read_taxonomy(spark, str(tmp_path / "n.dmp")))
    assert {x.node: x.depth for x in taxonomy.depths(closure).collect()} == {1: 3, 2: 2, 3: 1, 4: 1}
    assert taxonomy.lca(spark.createDataFrame([(3, 4), (3, 2)], "a long, b long"), closure).orderBy("b").collect()[0].lca == 2
    assert one(spark, "gi|1|ref|NC_1.2| x", taxonomy.taxid_label("x")) == "NC_1.2" and one(spark, "kraken:taxid|77|z", taxonomy.taxid_label("x")) == "77"
    writers.write_fasta(spark.createDataFrame([("n", "ACGT")], "name string, seq string"), str(tmp_path / "out"), name="name")
    assert [x.seq for x in readers.read_fasta(spark, str(tmp_path / "out")).collect()] == ["ACGT"]


def test_index_from_files_and_service(spark, tmp_path):
    for n, s in THREE:
        (tmp_path / f"{n}.fa").write_text(f">{n}\n{s}\n")
    index = build_index(spark, {n: [str(tmp_path / f"{n}.fa")] for n, _ in THREE}, str(tmp_path / "index"), 5)
    service = Service(spark, {"g": [index]}, {"g": KmerGraph.build(spark.createDataFrame(THREE, "label string, seq string"), 5, DNA)})
    assert {x.label: x.matches for x in service.search(ASKED, discovery_fraction=0.0).collect()} == {"seq1": 10, "seq2": 13, "seq3": 12}
    df = service.search_pandas([ASKED], discovery_fraction=0.9)
    assert sorted(df["sample"]) == ["seq2", "seq3"]
    assert service.align(ASKED, "g").first().cigar == f"{len(ASKED)}="
    assert service.column_labels().count() == 3 and service.stats("g")["annotation"]["labels"] == 3
    assert len(service.search_async([ASKED, ASKED])[1].result()) == 3
    assert mode_of(query_coords=True, query_counts=True) == "coords" and mode_of() == "matches"
    for bad in (lambda: service.search(""), lambda: service.search("A", graphs=["x"]), lambda: service.search("A", discovery_fraction=2), lambda: service.align("A", "x")):
        with pytest.raises(BadRequest):
            bad()
    with pytest.raises(ValueError, match="coords"):
        q.query(index, spark.createDataFrame([(0, ASKED)], "query_id long, seq string"), "coords").collect()


def test_service_over_http(spark, three):
    service = Service(spark, {"g": [three[0]], "h": [three[0]]}, {"g": KmerGraph.build(spark.createDataFrame(THREE, "label string, seq string"), 5, DNA)})
    running = serve(service)
    try:
        client = Client(f"http://127.0.0.1:{running.server_port}")
        (found,) = client.search(ASKED, graphs=["g"], discovery_fraction=0)
        assert found["seq_description"] == "0" and [(x["sample"], x["kmer_count"]) for x in found["results"]] == [("seq2", 13), ("seq3", 12), ("seq1", 10)]
        other = ASKED[:8] + "A" + ASKED[9:]
        both = client.search([ASKED, other], graphs=["g"], query_coords=True, top_labels=1, discovery_fraction=1.0)
        assert [x["results"] and x["results"][0]["kmer_coords"] for x in both] == ["1-10-13:1-6-13:9-2-5:5-2-9:0-1-13", []]
        assert client.align([ASKED, "TTTTTTTT"])[0]["alignments"][0]["cigar"] == "17=" and client.align(["TTTTTTTT"])[0]["alignments"] == []
        aligned = client.search([ASKED], align_first="g", graphs=["g"], with_signature=True)[0]
        assert aligned["best_alignment"]["sequence"] == ASKED and aligned["results"][0]["signature"] == "x13"
        assert client.column_labels() == ["seq1", "seq2", "seq3"] and client.stats()["g"]["graph"]["k"] == 5
        many = Clients({"a": client, "b": client}).search(ASKED, discovery_fraction=0.9)
        assert many["a"] == many["b"] and len(many["a"][0]["results"]) == 4  # two labels of two indexes
        for bad in ({"graphs": ["x"]}, {"discovery_fraction": 2}, {"discovery_fraction": "x"}, {"top_labels": True}):
            with pytest.raises(BadRequest):
                client.search(ASKED, **bad)
        for path, body in (("/search", [1]), ("/search", {}), ("/align", {"FASTA": 3})):
            with pytest.raises(BadRequest):
                client._ask(path, body)
        with pytest.raises(RuntimeError, match="404"):
            client._ask("/nothing")
    finally:
        running.shutdown()
        running.server_close()


@pytest.mark.parametrize("mode", ["basic", "primary"])
def test_index_of_cleaned_samples(spark, tmp_path, mode):
    """Counts below the least go sample by sample, with and without tips removed; queries find either strand's form in primary mode."""
    r = random.Random(3)
    a, b = ("".join(r.choices("ACGT", k=60)) for _ in range(2))
    (tmp_path / "a.fa").write_text(f">1\n{a}\n>2\n{a}\n>3\n{a[:30]}{b[:1]}ACGTTG\n")
    (tmp_path / "b.fa").write_text(f">1\n{b}\n>2\n{b}\n")
    asked = spark.createDataFrame([(0, a), (1, b)], "query_id long, seq string")
    for n, tip in enumerate((0, 4)):
        index = build_index(spark, {x: [str(tmp_path / f"{x}.fa")] for x in "ab"}, str(tmp_path / f"index{n}"), 11, mode=mode, min_count=2, tip_size=tip, with_counts=True)
        got = {(x.query_id, x.label): x.matches for x in q.query(index, asked, "matches", 0.9).collect()}
        assert got == {(0, "a"): 50, (1, "b"): 50}
        if tip == 0:
            count = Counter(min(k, revcomp_of(k)) if mode == "primary" else k for s in (a, a, f"{a[:30]}{b[:1]}ACGTTG") for k in (s[i : i + 11] for i in range(len(s) - 10)))
            assert {x.kmer: x["count"] for x in index.stored.where("label = 'a'").collect()} == {k: v for k, v in count.items() if v > 1}


def revcomp_of(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_stream(spark, tmp_path):
    schema = "label string, seq string"
    for n in range(2):
        spark.createDataFrame(THREE, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), 5, DNA).awaitTermination()
        got = {(x.kmer, x.label): x["count"] for x in incremental.annotation(spark, str(tmp_path / "out")).collect()}
        want = {k: v * (n + 1) for k, v in Counter((s[i : i + 5], name) for name, s in THREE for i in range(len(s) - 4)).items()}
        assert got == want


def test_smooth_and_quantile(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1, 5, 9, 2, 2])], "g int, pos int, v long")
    got = [x.s for x in df.select("pos", fmt.smooth(["g"], "pos", "v", 4).alias("s")).orderBy("pos").collect()]
    assert got == [3, 5, 4, 5, 4]  # two to the left, one to the right, halves away from zero
    h = spark.createDataFrame([(0, 1, 5), (0, 2, 4), (0, 7, 1)], "g int, value long, n long")
    assert [fmt.quantile(h, ["g"], "value", "n", x).first().quantile for x in (0.5, 0.51, 0.9, 1.0)] == [1, 2, 2, 7]
    assert df.select(F.count("*")).first()[0] == 5


def test_one_form_of_each_kmer(spark):
    r = random.Random(6)
    g = KmerGraph.build(seqs(spark, *("".join(r.choices("ACGT", k=120)) for _ in range(2))), 5, DNA, "canonical")
    spelled = [x.seq for x in paths.primary_contigs(g).collect()]
    flip = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert sorted(min(s[i : i + 5], flip(s[i : i + 5])) for s in spelled for i in range(len(s) - 4)) == sorted(x.kmer for x in g.kmers.collect())


def test_differential_unitigs_and_sequences(spark):
    df = spark.createDataFrame([(0, "A", "ACGGTCATTGAC"), (1, "B", "GGTCATTG"), (2, "C", "TCATT")], "seq_id long, label string, seq string")
    g, anno = KmerGraph.build(df, 4, DNA), annotation.annotate(df, 4, alphabet=DNA)
    rule = differential.Rule("x", ["A", "B"], ["C"], unitig_out_max_fraction=0.5)
    # k-mers of A and B: GGTC to ATTG, five of them in a row, two of which C has
    assert [x.kmer for x in differential.by_unitig(g, anno, rule).orderBy("pos").collect()] == ["GGTC", "GTCA", "TCAT", "CATT", "ATTG"]
    strict = differential.Rule("x", ["A", "B"], ["C"], unitig_out_max_fraction=0.3)
    assert differential.by_unitig(g, anno, strict).count() == 0
    assert sorted(x.seq for x in differential.assemble(g, anno, rule).collect()) == ["ATTG", "GGTCA"]
    assert [x.seq for x in differential.assemble(g, anno, rule, by="unitig").collect()] == ["GGTCATTG"]
