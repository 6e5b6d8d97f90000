"""More of the engine's operators as queries: text functions, annotation upkeep, query modes by header, cleaned outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as fmt
from .functions.alphabet import DNA, PROTEIN
from .functions.cigar import dna_matrix
from .functions.kmers import code, explode_kmers
from .functions.numbers import unzigzag, zigzag
from .operators import annotation, clean, columns, paths, stats
from .operators.graph import KmerGraph
from .plans import query as q
from .plans.storage import scratch_path, stored
from .registry import (
    ANNO, COUNTS, DD, DK, DNA_K, DS, K, LEAST, MATCH, NAME_GRAPH, QK, SMALL, SMALL_GRAPH, TALK_GRAPH, TS, _HEADERS, _MATCH_COORDS, _SCORE, _UNITIGS,
    dna, dna_sql, docs, headers, corpus, kmers_sql, name_graph, names, passages, protein_sql, rc_sql, register, small_anno, small_counts, small_graph, stored_once, table, talk_graph, talks,
)
from .sources import writers

# -- text functions over whole documents

_MASKS = f"(SELECT doc_id AS query_id, regexp_replace(regexp_replace({protein_sql('text')}, '[AEIOU]', '1', 'g'), '[^1]', '0', 'g') AS bits FROM documents)"


def masks(s, d):
    """Vowels are 1, all else is 0."""
    return docs(s, d).select(F.col("seq_id").alias("query_id"), F.translate(PROTEIN.normalise("seq"), PROTEIN.letters, "".join("01"[c in "AEIOU"] for c in PROTEIN.letters)).alias("bits"))


register("fn_mask_rle", f"SELECT query_id, array_to_string(list_transform(regexp_extract_all(bits, '0+|1+'), lambda x: (CASE WHEN x[1] = '1' THEN 'x' ELSE 'o' END)||length(x)), '') AS mask FROM {_MASKS}")(lambda s, d: masks(s, d).select("query_id", fmt.mask_rle("bits").alias("mask")))
_ER = _SCORE.replace("FROM s)", f"FROM (SELECT query_id, repeat(bits, 1) AS bits FROM {_MASKS} WHERE bits <> '') s)", 1)
register("fn_mask_score", f"WITH {_ER} SELECT query_id, CAST(CASE WHEN ones = 0 THEN 0 ELSE trunc(greatest((ones + zeros) * (length(bits) + {K} - 1) / length(bits), 0)) END AS INTEGER) AS score FROM t3")(lambda s, d: masks(s, d).where("bits <> ''").select("query_id", fmt.mask_score("bits", K).alias("score")))
_VALUES = f"SELECT query_id, pos, CASE WHEN kmer < 'H' THEN 0 WHEN kmer < 'P' THEN 1 ELSE 2 END AS v FROM ({kmers_sql('(SELECT item_id AS query_id, text FROM benchmark) b', 'query_id', protein_sql('text'), 1)})"


def values(s, d):
    """A small number for each letter of the passages."""
    return explode_kmers(passages(s, d), "seq", 1, ["query_id"]).select("query_id", "pos", F.when(F.col("kmer") < "H", 0).when(F.col("kmer") < "P", 1).otherwise(2).alias("v"))


register("fn_count_rle", f"SELECT query_id, string_agg(a||CASE WHEN z > a THEN '-'||z ELSE '' END||'='||v, ':' ORDER BY a) AS abundances FROM (SELECT query_id, v, run, min(pos) AS a, max(pos) AS z FROM (SELECT *, pos - row_number() OVER (PARTITION BY query_id, v ORDER BY pos) AS run FROM ({_VALUES}) WHERE v > 0) GROUP BY ALL) GROUP BY query_id")(lambda s, d: fmt.count_runs(values(s, d), ["query_id"], "pos", "v"))
register("fn_coord_ranges", f"SELECT query_id, string_agg(a||'-'||(a+dg)||CASE WHEN z > a THEN '-'||(z+dg) ELSE '' END, ':' ORDER BY z, z+dg) AS coords FROM (SELECT query_id, dg, run, min(pos) AS a, max(pos) AS z FROM (SELECT query_id, pos, dg, pos - row_number() OVER (PARTITION BY query_id, dg ORDER BY pos) AS run FROM (SELECT query_id, pos, v * 100 AS dg FROM ({_VALUES}))) GROUP BY ALL) GROUP BY query_id")(lambda s, d: fmt.coordinate_ranges(values(s, d).withColumn("coord", F.col("pos") + F.col("v") * 100), ["query_id"], "pos", "coord"))
register("fn_quantile", "WITH h AS (SELECT source, length(text) AS v, count(*) AS n FROM documents GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY v) AS upto, sum(n) OVER (PARTITION BY source) AS total FROM h) SELECT source, CAST(min(v) FILTER (upto >= 0.75 * total) AS BIGINT) AS quantile FROM c GROUP BY source")(lambda s, d: fmt.quantile(table(s, d, "documents").select("source", F.char_length("text").cast("long").alias("v")).groupBy("source", "v").agg(F.count("*").alias("n")), ["source"], "v", "n", 0.75))
register("fn_scoring_matrix", "SELECT a, b, CAST(CASE WHEN a = b THEN 2 WHEN a||b IN ('AG', 'GA', 'CT', 'TC') THEN -1 ELSE -3 END AS BIGINT) AS score FROM (SELECT unnest(['A','C','G','T']) AS a), (SELECT unnest(['A','C','G','T']) AS b)")(lambda s, d: s.createDataFrame([(a, b, x) for (a, b), x in dna_matrix(2, -1, -3).items()], "a string, b string, score long"))
register("fn_encode_diff", "SELECT doc_id, CASE WHEN doc_id < n_chars THEN 2 * (n_chars - doc_id) - 1 ELSE 2 * (doc_id - n_chars) END AS z, doc_id - n_chars AS back FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", zigzag(F.col("doc_id") - F.col("n_chars")).alias("z")).withColumn("back", unzigzag(F.col("z"))))
register("fn_spell_path", f"{_UNITIGS} SELECT head, max_by(seq, n_kmers) AS seq FROM w GROUP BY head")(lambda s, d: paths.unitigs(name_graph(s, d)).select("head", "seq"))
_CODE = "list_sum(list_transform(range(1, {k} + 1), lambda i: CAST((ascii(substr(kmer, i, 1)) - 65) AS BIGINT) * CAST(power(26, {k} - i) AS BIGINT)))"
register("index_ranges", f"SELECT kmer, CAST({_CODE.format(k=SMALL)} AS BIGINT) AS code, row_number() OVER (ORDER BY kmer) AS node FROM ({SMALL_GRAPH})")(lambda s, d: small_graph(s, d).numbered().select("kmer", code("kmer", PROTEIN).alias("code"), "node"))

# -- graph lookups

_PRIMARY = f"WITH g AS (SELECT DISTINCT least(kmer, {rc_sql('kmer')}) AS kmer FROM ({DD})), qk AS ({kmers_sql('(SELECT item_id AS query_id, text FROM benchmark) b', 'query_id', dna_sql('text'), DNA_K)})"
register("map_canonical_wrap", f"{_PRIMARY} SELECT query_id, CAST(pos AS BIGINT) AS pos, qk.kmer, g.kmer IS NOT NULL AS found FROM qk LEFT JOIN g ON least(qk.kmer, {rc_sql('qk.kmer')}) = g.kmer")(lambda s, d: KmerGraph.build(dna(docs(s, d)), DNA_K, DNA, "primary").map_kmers(dna(passages(s, d))).select("query_id", "pos", "kmer", "found"))
register("call_nodes", f"SELECT kmer, row_number() OVER (ORDER BY kmer) AS node FROM ({SMALL_GRAPH})")(lambda s, d: small_graph(s, d).numbered().select("kmer", "node"))
_KEPT_TIPS = f"{_UNITIGS}, u AS (SELECT head, max_by(kmer, n_kmers) AS last, max(n_kmers) AS n FROM w GROUP BY head), x AS (SELECT head, (SELECT count(*) FROM g WHERE right(g.kmer, 4) = left(head, 4)) + (SELECT count(*) FROM g WHERE left(g.kmer, 4) = right(last, 4)) AS deg, n FROM u)"
register("clean_tips", f"{_KEPT_TIPS} SELECT kmer, weight FROM g WHERE kmer IN (SELECT kmer FROM w JOIN x USING (head) WHERE NOT (x.n < 3 AND deg < 2))")(lambda s, d: clean.clean(name_graph(s, d), tip_size=3).kmers)
register("clean_output", f"{_UNITIGS} SELECT head, max_by(seq, n_kmers) AS seq, string_agg(weight, ',' ORDER BY n_kmers) AS counts FROM w JOIN g USING (kmer) GROUP BY head")(lambda s, d: paths.with_counts(name_graph(s, d), paths.unitig_chains(name_graph(s, d))).select("head", "seq", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts")))
register("clean_fallback", "SELECT CAST(7 AS BIGINT) AS threshold")(lambda s, d: s.createDataFrame([(clean.threshold(name_graph(s, d).mask("weight > 1"), fallback=7),)], "threshold long"))
register("st_histogram", f"SELECT weight, count(*) AS n FROM ({NAME_GRAPH}) GROUP BY weight")(lambda s, d: clean.histogram(name_graph(s, d)))

# -- annotation


@register("anno_update", f"SELECT DISTINCT kmer, label FROM ({DS}) UNION SELECT DISTINCT kmer, label FROM ({TS})")
def anno_update(s, d):
    """More sequences are appended to a stored annotation."""
    at = scratch_path(s, "anno")
    writers.write_annotation(small_anno(s, d), at)
    writers.append_annotation(annotation.annotate(talks(s, d), SMALL), at)
    return writers.read_annotation(s, at).distinct()


register("anno_insert_rows", f"WITH g AS (SELECT kmer FROM ({SMALL_GRAPH}) UNION SELECT kmer FROM ({TALK_GRAPH})) SELECT kmer, count(label) AS n_labels FROM g LEFT JOIN ({ANNO}) USING (kmer) GROUP BY kmer")(lambda s, d: annotation.rows_for(small_graph(s, d).extend(talks(s, d)), small_anno(s, d)))
register("label_decode", f"WITH ids AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM (SELECT DISTINCT label FROM ({ANNO}))) SELECT kmer, label_id, label FROM ({ANNO}) JOIN ids USING (label)")(lambda s, d: annotation.decoded(annotation.encoded(small_anno(s, d), annotation.encode_labels(small_anno(s, d))), annotation.encode_labels(small_anno(s, d))))
register("label_exists", "SELECT l AS label, l IN (SELECT source FROM documents) AS exists FROM (SELECT unnest(['src1', 'src2', 'nothing']) AS l)")(lambda s, d: annotation.exists(small_anno(s, d), s.createDataFrame([("src1",), ("src2",), ("nothing",)], "label string")))
register("mat_get_rows", f"WITH r AS (SELECT kmer, string_agg(label, ',' ORDER BY label) AS labels FROM ({ANNO}) WHERE kmer IN (SELECT kmer FROM ({TALK_GRAPH})) GROUP BY kmer) SELECT labels, count(*) AS n_rows FROM r GROUP BY labels")(lambda s, d: annotation.distinct_rows(small_anno(s, d), talk_graph(s, d).kmers).select(F.array_join("labels", ",").alias("labels"), "n_rows"))
register("mat_get_column", f"SELECT kmer FROM ({ANNO}) WHERE label = 'src4'")(lambda s, d: annotation.kmers_of(small_anno(s, d), "src4").select("kmer"))
register("mat_row_values", f"SELECT kmer, label, count FROM ({COUNTS}) WHERE kmer IN (SELECT kmer FROM ({TALK_GRAPH}))")(lambda s, d: small_counts(s, d).join(talk_graph(s, d).kmers.select("kmer"), "kmer", "left_semi"))
register("map_local_coords", f"WITH h AS ({_HEADERS}), c AS (SELECT file, start AS coord FROM h UNION ALL SELECT file, start + n_kmers - 1 FROM h) SELECT c.file, coord, header, coord - start AS local FROM c JOIN h ON c.file = h.file AND coord >= start AND coord < start + n_kmers")(lambda s, d: (lambda h: annotation.locate(h.select("file", F.col("start").alias("coord")).unionByName(h.select("file", (F.col("start") + F.col("n_kmers") - 1).alias("coord"))), h).select("file", "coord", "header", "local"))(headers(s, d)))
register("num_kmers_in_sequence", "SELECT CAST(doc_id AS VARCHAR) AS header, CAST(length(text) - 11 AS BIGINT) AS n_kmers FROM documents WHERE length(text) >= 12")(lambda s, d: headers(s, d).select("header", "n_kmers"))


@register("anno_rainbow", ANNO)
def anno_rainbow(s, d):
    """A colour for each k-mer and the labels of each colour, written and read back."""
    at = scratch_path(s, "rainbow")
    writers.write_colours(small_anno(s, d), at)
    return writers.read_colours(s, at)


register("anno_row_diff", ANNO)(lambda s, d: (lambda g, a: columns.from_row_diff(stored(columns.row_diff(a, g.edges()), "row-diff")))(*stored_once(s, d)))
register("st_anno_rows", f"SELECT count(DISTINCT labels) AS distinct_rows FROM (SELECT string_agg(label, ',' ORDER BY label) AS labels FROM ({ANNO}) GROUP BY kmer)")(lambda s, d: columns.row_classes(small_anno(s, d)).agg(F.count("*").alias("distinct_rows")))
register("col_subsample_all", ANNO)(lambda s, d: columns.subsample(small_anno(s, d), 1))
register("st_count_histogram", f"SELECT label, count, count(*) AS n FROM ({COUNTS}) GROUP BY ALL")(lambda s, d: stats.count_histogram(small_counts(s, d)))

# -- query modes

register("q_signature_full", f"{MATCH.replace(LEAST, 'max(n_kmers)')} SELECT query_id, label, matches, 'x'||n_kmers AS mask, CAST(n_kmers + {K} - 1 AS INTEGER) AS score FROM m")(lambda s, d: q.query(corpus(s, d), passages(s, d), "signature", discovery_fraction=1.0))
register("q_batch", f"{MATCH} SELECT * FROM m")(lambda s, d: q.in_batches(corpus(s, d), passages(s, d), letters=10_000))
register("q_corpus", f"{MATCH} SELECT * FROM m")(lambda s, d: q.query(q.Index(K, sequences=docs(s, d)), passages(s, d)))
_LOCAL = f"{_MATCH_COORDS}, p AS (SELECT DISTINCT query_id, CAST(seq_id AS VARCHAR) AS header, qk.pos, qk.n_kmers, hit.pos AS coord FROM qk JOIN hit USING (kmer)), m AS (SELECT query_id, header, count(DISTINCT pos) AS matches, count(*) AS total FROM p GROUP BY ALL HAVING count(DISTINCT pos) >= {LEAST})"
register("q_cth_labels", f"{_LOCAL} SELECT query_id, header FROM m")(lambda s, d: q.by_headers(corpus(s, d), passages(s, d), headers(s, d), mode="labels"))
register("q_cth_counts_sum", f"{_LOCAL} SELECT query_id, header, total FROM m")(lambda s, d: q.by_headers(corpus(s, d), passages(s, d), headers(s, d), mode="counts_sum"))
register("q_cth_counts", f"{_LOCAL}, c AS (SELECT query_id, header, pos, count(*) AS c FROM p JOIN m USING (query_id, header) GROUP BY ALL), r AS (SELECT *, pos - row_number() OVER (PARTITION BY query_id, header, c ORDER BY pos) AS run FROM c), i AS (SELECT query_id, header, c, min(pos) AS a, max(pos) AS z FROM r GROUP BY query_id, header, c, run) SELECT query_id, header, matches, string_agg(a||CASE WHEN z > a THEN '-'||z ELSE '' END||'='||c, ':' ORDER BY a) AS abundances FROM i JOIN m USING (query_id, header) GROUP BY ALL")(lambda s, d: q.by_headers(corpus(s, d), passages(s, d), headers(s, d), mode="counts"))
register("q_cth_coords", f"{_LOCAL}, r AS (SELECT query_id, header, pos, coord - pos AS dg, pos - row_number() OVER (PARTITION BY query_id, header, coord - pos ORDER BY pos) AS run FROM p JOIN m USING (query_id, header)), i AS (SELECT query_id, header, dg, min(pos) AS a, max(pos) AS z FROM r GROUP BY query_id, header, dg, run) SELECT query_id, header, matches, string_agg(a||'-'||(a+dg)||CASE WHEN z > a THEN '-'||(z+dg) ELSE '' END, ':' ORDER BY z, z+dg) AS coords FROM i JOIN m USING (query_id, header) GROUP BY ALL")(lambda s, d: q.by_headers(corpus(s, d), passages(s, d), headers(s, d), mode="coords"))
register("q_no_coord_map", f"{MATCH} SELECT query_id, label, matches FROM m")(lambda s, d: q.query(corpus(s, d), passages(s, d), "matches").select("query_id", "label", "matches"))  # headers are known, labels are asked for
_NAMES = kmers_sql("part", "p_partkey", protein_sql("p_name"), 5)
register("q_align", f"WITH qk AS ({_NAMES}), anno AS (SELECT DISTINCT p_brand AS label, kmer FROM ({kmers_sql('part', 'p_brand', protein_sql('p_name'), 5)})) SELECT p_partkey AS query_id, label, count(*) AS matches, max(n_kmers) AS n_kmers FROM qk JOIN anno USING (kmer) GROUP BY ALL HAVING count(*) >= {LEAST}")(lambda s, d: q.aligned_query(name_graph(s, d), q.Index(5, sequences=table(s, d, "part").select(F.col("p_brand").alias("label"), F.col("p_name").alias("seq"))), names(s, d)))
register("q_format_suppressed", f"WITH qk AS ({QK}), hit AS (SELECT DISTINCT label, kmer FROM ({DK}) WHERE kmer IN (SELECT kmer FROM qk)), m AS (SELECT query_id, label, count(*) AS n FROM qk JOIN hit USING (kmer) GROUP BY ALL HAVING count(*) >= {LEAST}) SELECT item_id||coalesce((SELECT chr(9)||string_agg('<'||label||'>:'||n, chr(9) ORDER BY n DESC, label) FROM m WHERE query_id = item_id), '') AS line FROM benchmark")(lambda s, d: q.as_tsv(q.query(corpus(s, d), passages(s, d)), queries=passages(s, d)))
