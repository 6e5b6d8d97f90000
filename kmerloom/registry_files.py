"""Sources and sinks as queries: a file is written from a test table, read back, and compared with the table by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.alphabet import DNA, PROTEIN
from .operators.graph import KmerGraph
from .plans import query as q
from .plans.storage import scratch_path
from .registry import ANNO, COUNTS, DNA_K, MATCH, SMALL_GRAPH, _TREE, corpus, dna, dna_sql, docs, passages, protein_sql, rc_sql, register, small_anno, small_counts, small_graph, tree
from .sources import readers, writers


def _letters(s, d, alphabet=PROTEIN):
    """name and seq of the documents, over an alphabet; documents without a letter of it are left out."""
    rows = docs(s, d) if alphabet is PROTEIN else dna(docs(s, d))
    return rows.select(F.col("seq_id").cast("string").alias("name"), alphabet.normalise("seq").alias("seq")).where("seq <> ''")


def _fasta(s, d, compression="none", alphabet=PROTEIN):
    at = scratch_path(s, "fasta") + ".fa"
    writers.write_fasta(_letters(s, d, alphabet), at, name="name", compression=compression)
    return at


def _fastq(s, d):
    at = scratch_path(s, "fastq") + ".fq"
    lines = _letters(s, d).select(F.concat(F.lit("@"), "name", F.lit(" read\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("@"), F.char_length("seq"))).alias("value"))
    lines.write.text(at)
    return at


_PLAIN = f"SELECT CAST(doc_id AS VARCHAR) AS name, {protein_sql('text')} AS seq FROM documents WHERE length(text) > 0"
_PLAIN_DNA = f"SELECT CAST(doc_id AS VARCHAR) AS name, {dna_sql('text')} AS seq FROM documents WHERE length({dna_sql('text')}) > 0"
_named = lambda df: df.select("name", "seq")

register("src_fasta", _PLAIN)(lambda s, d: _named(readers.read_fasta(s, _fasta(s, d))))
register("src_fastq", _PLAIN)(lambda s, d: _named(readers.read_fastq(s, _fastq(s, d))))
register("src_compression", _PLAIN)(lambda s, d: _named(readers.read_fasta(s, _fasta(s, d, "gzip"))))
register("src_dispatch", f"{_PLAIN} UNION ALL {_PLAIN}")(lambda s, d: _named(readers.read_sequences(s, _fasta(s, d)).unionByName(readers.read_sequences(s, _fastq(s, d)))))
register("src_stdin_list", f"{_PLAIN} UNION ALL {_PLAIN} UNION ALL {_PLAIN}")(lambda s, d: _named(readers.read_many(s, [_fasta(s, d), _fasta(s, d, "gzip"), _fastq(s, d)])))
register("src_parser_iter", f"SELECT *, false AS reverse FROM ({_PLAIN_DNA}) UNION ALL SELECT name, {rc_sql('seq')}, true FROM ({_PLAIN_DNA})")(lambda s, d: readers.with_reverse(_letters(s, d, DNA)))
register("src_fasta_string", "SELECT 'r'||r_regionkey AS name, replace(r_name, ' ', '') AS seq FROM region")(lambda s, d: _named(readers.read_string(s, "".join(f">r{x.r_regionkey} c\n{x.r_name}\n" for x in s.read.parquet(f"{d}/region.parquet").collect()))))  # five rows
register("src_format_detect", "SELECT n AS file, f AS format FROM (VALUES ('a.fa', 'fasta'), ('b.fq.gz', 'fastq'), ('c.vcf.zst', 'vcf'), ('d.kmc_suf', 'kmc'), ('e.other', 'fasta'), ('f.fasta.bgz', 'fasta')) t(n, f)")(lambda s, d: s.createDataFrame([(n, readers.file_format(n)) for n in ("a.fa", "b.fq.gz", "c.vcf.zst", "d.kmc_suf", "e.other", "f.fasta.bgz")], "file string, format string"))
register("snk_fasta", f"SELECT '>'||name||chr(10)||seq AS value FROM ({_PLAIN})")(lambda s, d: writers.fasta_lines(_letters(s, d), name="name"))


@register("src_count_run_split", f"SELECT name, CAST(r * 50 AS INTEGER) AS piece, substr(seq, r * 50 + 1, CAST(least(50, n - r * 50) AS INTEGER) + {DNA_K - 1}) AS seq, r % 3 AS count FROM (SELECT *, length(seq) - {DNA_K - 1} AS n FROM ({_PLAIN_DNA})), unnest(range(0, CAST(ceil(greatest(n, 0) / 50.0) AS BIGINT))) AS u(r)")
def src_count_run_split(s, d):
    rows = _letters(s, d, DNA).where(F.char_length("seq") >= DNA_K)
    counted = rows.select(F.col("name").alias("seq_no"), "seq", F.transform(F.sequence(F.lit(0), F.char_length("seq") - DNA_K), lambda i: F.floor(i / 50) % 3).alias("counts"))
    return readers.count_runs(counted, DNA_K).select(F.col("seq_no").alias("name"), "piece", "seq", F.col("count").cast("long").alias("count"))


def _variants(s, d):
    """A passing variant at letter 15 of each document that has 30 letters, with a copy number and two samples."""
    rows = _letters(s, d, DNA).where(F.char_length("seq") >= 30)
    at = scratch_path(s, "variants") + ".vcf"
    line = F.concat_ws("\t", "name", F.lit("15"), F.lit("."), F.substring("seq", 15, 1), F.lit("AC,<CN2>"), F.lit("."), F.lit("PASS"), F.lit("DB;AF=1;N=0"), F.lit("GT"), F.lit("0|1"), F.lit("2|0"))
    head = s.createDataFrame([("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2",)], "value string")
    head.unionByName(rows.select(line.alias("value"))).coalesce(1).write.text(at)  # a header and its lines are one file
    return at, rows


_VCF = f"SELECT name AS contig, substr(seq, 10, 5)||a||substr(seq, 16, 5) AS seq, l AS sample FROM (SELECT name, seq, unnest(['AC', substr(seq, 15, 1)||substr(seq, 15, 1)]) AS a, unnest(['s1', 's2']) AS l FROM ({_PLAIN_DNA}) WHERE length(seq) >= 30)"


@register("src_vcf", f"SELECT contig, seq FROM ({_VCF})")
def src_vcf(s, d):
    at, rows = _variants(s, d)
    return readers.read_vcf(s, at, rows, 5).select("contig", "seq")


@register("src_vcf_anno", f"SELECT contig, seq, contig||',DB,AF,'||sample AS labels FROM ({_VCF})")
def src_vcf_anno(s, d):
    at, rows = _variants(s, d)
    return readers.read_vcf(s, at, rows, 5, ["DB", "AF", "N"]).select("contig", "seq", F.array_join("labels", ",").alias("labels"))


@register("src_kmc", f"SELECT kmer, weight AS cnt FROM ({SMALL_GRAPH}) WHERE weight >= 3 AND weight < 40")
def src_kmc(s, d):
    at = scratch_path(s, "counts") + ".tsv"
    small_graph(s, d).kmers.write.option("sep", "\t").csv(at)
    return readers.read_counts(s, at, 3, 40)


@register("src_fasta_counts", f"SELECT name, seq, array_to_string(list_transform(range(length(seq) - {DNA_K - 1}), lambda x: x % 9 + 1), ',') AS counts FROM ({_PLAIN_DNA}) WHERE length(seq) >= {DNA_K}")
def src_fasta_counts(s, d):
    rows = _letters(s, d, DNA).where(F.char_length("seq") >= DNA_K).withColumn("counts", F.transform(F.sequence(F.lit(0), F.char_length("seq") - DNA_K), lambda i: (i % 9 + 1).cast("long")))
    at = scratch_path(s, "counted")
    writers.write_fasta_counts(rows, at, DNA_K, name="name")
    return readers.read_fasta_counts(s, at).select("name", "seq", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@register("src_rename_rules", "SELECT 'old'||n_nationkey AS old, 'new'||n_regionkey AS new FROM nation")
def src_rename_rules(s, d):
    at = scratch_path(s, "rules")
    s.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("  old"), F.col("n_nationkey").cast("string"), F.lit("\t new"), F.col("n_regionkey").cast("string")).alias("value")).write.text(at)
    return readers.read_rules(s, at)


@register("src_linkage", "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b, CAST(n_nationkey * 100 AS BIGINT) AS n_bits, CAST(n_nationkey + 25 AS BIGINT) AS cluster FROM nation")
def src_linkage(s, d):
    at, n = scratch_path(s, "linkage"), F.col("n_nationkey")
    s.read.parquet(f"{d}/nation.parquet").select(F.concat_ws(" ", n.cast("string"), F.col("n_regionkey").cast("string"), F.concat((n * 100).cast("string"), F.lit(".0")), (n + 25).cast("string")).alias("value")).write.text(at)
    return readers.read_linkage(s, at)


@register("src_tax", f"{_TREE} SELECT CAST(child AS BIGINT) AS child, CAST(parent AS BIGINT) AS parent, 'rank' AS rank FROM t")
def src_tax(s, d):
    at = scratch_path(s, "nodes")
    tree(s, d).select(F.concat(F.col("child").cast("string"), F.lit("\t|\t"), F.col("parent").cast("string"), F.lit("\t|\trank\t|")).alias("value")).write.text(at)
    return readers.read_taxonomy(s, at)


@register("src_graph", SMALL_GRAPH)
def src_graph(s, d):
    at = scratch_path(s, "graph")
    writers.write_graph(small_graph(s, d), at)
    return writers.read_graph(s, at).kmers


@register("src_anno", COUNTS)
def src_anno(s, d):
    at = scratch_path(s, "anno")
    writers.write_annotation(small_counts(s, d), at)
    return writers.read_annotation(s, at)


@register("annotate_separately", ANNO)
def annotate_separately(s, d):
    at = scratch_path(s, "anno")
    writers.write_annotation(small_anno(s, d), at, separately=True)
    return writers.read_annotation(s, at).select("kmer", "label")


@register("snk_text_anno", ANNO)
def snk_text_anno(s, d):
    at = scratch_path(s, "columns")
    writers.write_text_columns(small_anno(s, d), at)
    return s.read.text(at).select(F.col("value").alias("kmer"), "label")


@register("build_chunks", SMALL_GRAPH)
def build_chunks(s, d):
    """A part for each last letter, read back as one graph."""
    at, g = scratch_path(s, "chunks"), small_graph(s, d)
    g.kmers.withColumn("suffix", F.right("kmer", F.lit(1))).write.partitionBy("suffix").parquet(at)
    return KmerGraph(s.read.parquet(at).drop("suffix"), g.k).kmers


@register("snk_json", f"{MATCH} SELECT query_id, '['||string_agg('{{\"label\":{{\"sample\":\"'||label||'\",\"properties\":{{}}}},\"kmer_count\":'||matches||'}}', ',' ORDER BY matches DESC, label)||']' AS json FROM m GROUP BY query_id")
def snk_json(s, d):
    return q.as_json(q.query(corpus(s, d), passages(s, d)))


@register("snk_gfa_merge", "SELECT 'S'||chr(9)||doc_id AS line FROM documents UNION ALL SELECT 'P'||chr(9)||row_number() OVER (ORDER BY 'x'||lpad(CAST(item_id AS VARCHAR), 9, '0'))||chr(9)||item_id||'+'||chr(9)||'4M' FROM benchmark")
def snk_gfa_merge(s, d):
    graph = docs(s, d).select(F.concat(F.lit("S\t"), F.col("seq_id").cast("string")).alias("line"))
    each = passages(s, d).select(F.concat_ws("\t", F.lit("P"), F.concat(F.lit("x"), F.lpad(F.col("query_id").cast("string"), 9, "0")), F.concat(F.col("query_id").cast("string"), F.lit("+")), F.lit("4M")).alias("line"))
    return writers.merge_gfa(graph, each)

