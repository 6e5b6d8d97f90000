"""The query family: which labels hold enough of a query's k-mers, in six modes. Each is one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fmt
from ..functions.alphabet import ALPHABETS, PROTEIN, Alphabet
from ..functions.kmers import canonical, code, explode_kmers, fits_code, spread
from ..functions.scan import find_kmers
from ..operators import annotation
from ..operators.graph import saturated
from .storage import fine_splits, stored

MODES = ("labels", "matches", "counts_sum", "counts", "coords", "signature")


def min_count(fraction: float, n: Column) -> Column:
    """The least matches: the fraction of all windows, rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.lit(float(fraction)) * n)).cast("long")


@dataclass
class Index:
    """Labelled sequences (label and seq, further seq_id for coordinates), annotated anew for the k-mers of each batch of queries; or a stored annotation.

    With sequences only, the k-mers of the queries are semi-joined before anything is
    shuffled, so a query moves what it matches and not the corpus.
    """

    k: int
    alphabet: Alphabet = PROTEIN
    sequences: DataFrame | None = None
    stored: DataFrame | None = None
    mode: str = "basic"
    #: Whether the stored k-mers are numbers (``functions.kmers.code``).
    coded: bool = False

    def rows(self, only: DataFrame, value: str | None) -> DataFrame:
        """kmer, label (and count or coords) of the k-mers in ``only``."""
        if self.stored is not None:
            if value and value not in self.stored.columns:
                raise ValueError(f"the annotation has no {value}")
            return self.stored.select("kmer", "label", *[value] * bool(value)).join(only, "kmer", "left_semi")
        source = self._source()
        if value == "count":
            return annotation.annotate_counts(source, self.k, alphabet=self.alphabet, only=only)
        if value == "coords":
            return annotation.annotate_coords(source, self.k, alphabet=self.alphabet, only=only)
        return annotation.annotate(source, self.k, alphabet=self.alphabet, only=only)

    def _source(self) -> DataFrame:
        source = spread(self.sequences)
        if self.mode != "basic":
            source = source.withColumn("seq", self.alphabet.normalise("seq"))
            source = source.unionByName(source.withColumn("seq", self.alphabet.reverse_complement("seq")))
        return source

    def found(self, only: DataFrame, value: str | None) -> DataFrame:
        """The same as ``rows`` over sequences, for k-mers as numbers that are few enough to go to every task."""
        source, wanted = self._source(), [x.kmer for x in only.collect()]
        key = ["label", "seq_id"] if value == "coords" else ["label"]
        hits = find_kmers(source, "seq", self.k, key, self.alphabet, wanted)
        if value == "coords":
            hits = hits.join(annotation.offsets(source, self.k), key).groupBy("kmer", "label").agg(F.sort_array(F.collect_list(F.col("start") + F.col("pos"))).alias("coords"))
        elif value == "count":
            hits = hits.groupBy("kmer", "label").agg(saturated(F.count("*")).alias("count"))
        else:
            hits = hits.select("kmer", "label").distinct()
        return hits


#: Windows of the queries up to which they are broadcast to a stored annotation, about 50 MB.
FEW_WINDOWS = 1 << 20


def write_index(sequences: DataFrame, to: str, k: int, alphabet: Alphabet = PROTEIN, parts: int | None = None) -> None:
    """Store the annotation of labelled sequences (seq_id, label, seq) for all modes: kmer, label, count, coords.

    k-mers that fit are numbers. Rows lie in ranges of k-mers, sorted, so neighbouring
    k-mers share files and row groups; one exchange deals the ranges and does for the aggregate as well.
    """
    placed = annotation.placed(spread(sequences), k)
    found = explode_kmers(placed, "seq", k, ["label", "start"], alphabet)
    kmer = code("kmer", alphabet) if fits_code(k, alphabet) else F.col("kmer")
    rows = found.select(kmer.alias("kmer"), "label", (F.col("start") + F.col("pos")).alias("coord"))
    n = parts or int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = rows.repartitionByRange(n, "kmer").groupBy("kmer", "label").agg(F.count("*").alias("count"), F.sort_array(F.collect_list("coord")).alias("coords"))
    each.sortWithinPartitions("kmer", "label").write.parquet(f"{to}/annotation")
    sequences.sparkSession.createDataFrame([(k, alphabet.name, fits_code(k, alphabet))], "k int, alphabet string, coded boolean").write.json(f"{to}/about")


def read_index(spark, at: str) -> Index:
    about = spark.read.schema("k int, alphabet string, coded boolean").json(f"{at}/about").first()
    return Index(about.k, ALPHABETS[about.alphabet], stored=spark.read.parquet(f"{at}/annotation"), coded=about.coded)


def _few(queries: DataFrame) -> bool:
    return (queries.agg(F.sum(F.char_length("seq"))).first()[0] or 0) <= FEW_WINDOWS


def _matched(index: Index, windows: DataFrame, letters: DataFrame, value: str | None) -> tuple[DataFrame, DataFrame]:
    """The index's rows of the windows' k-mers, and the windows joined to them. Few windows go to the stored rows; else the rows are reduced before they move."""
    if index.stored is not None and _few(letters):
        if value and value not in index.stored.columns:
            raise ValueError(f"the annotation has no {value}")
        rows = index.stored.select("kmer", "label", *[value] * bool(value))
        return rows.join(F.broadcast(windows.select("kmer").distinct()), "kmer", "left_semi"), rows.join(F.broadcast(windows), "kmer")
    only = windows.select("kmer").distinct()
    if index.stored is not None:
        rows = index.rows(only, value)
    else:  # the corpus is read once, whatever the mode then asks of the rows
        with fine_splits(only.sparkSession):
            rows = stored(index.found(only, value) if _scanned(index, letters) else index.rows(only, value), "matched")
    return rows, windows.join(rows, "kmer")


def _scanned(index: Index, queries: DataFrame) -> bool:
    """Whether every task looks for the queries' k-mers in its sequences, as numbers."""
    return index.stored is None and fits_code(index.k, index.alphabet) and _few(queries)


def query(index: Index, queries: DataFrame, mode: str = "matches", discovery_fraction: float = 0.7, presence_fraction: float = 0.0, top_n: int | None = None, fwd_and_reverse: bool = False) -> DataFrame:
    """query_id, label and what the mode adds; queries: query_id and seq.

    labels: nothing; matches: matches; counts_sum: total; counts: abundances by runs of
    places; coords: coordinate ranges; signature: mask by runs and score. A window with
    letters outside the alphabet counts among all windows but matches nothing.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    k, alphabet = index.k, index.alphabet
    queries = queries.select("query_id", "seq")
    if fwd_and_reverse:
        queries = queries.select("query_id", "seq", F.lit("+").alias("strand")).unionByName(queries.select("query_id", alphabet.reverse_complement(alphabet.normalise("seq")).alias("seq"), F.lit("-").alias("strand")))
    by = ["query_id", "strand"] if fwd_and_reverse else ["query_id"]
    windows = explode_kmers(queries, "seq", k, by, alphabet)
    if index.mode == "primary" or (index.mode == "canonical" and index.stored is not None):
        windows = windows.withColumn("kmer", canonical(F.col("kmer"), alphabet))
    if index.coded or _scanned(index, queries):
        windows = windows.withColumn("kmer", code("kmer", alphabet))
    value = {"counts_sum": "count", "counts": "count", "coords": "coords"}.get(mode)
    rows, hits = _matched(index, windows, queries, value)
    if presence_fraction > 0:
        present = windows.join(rows.select("kmer").distinct(), "kmer", "left_semi").groupBy(*by).agg(F.count("*").alias("present"), F.max("n_kmers").alias("n"))
        hits = hits.join(present.where(F.col("present") >= min_count(presence_fraction, F.col("n"))).select(*by), by, "left_semi")
    key = [*by, "label"]
    sums = [F.count("*").alias("matches"), F.max("n_kmers").alias("n_kmers")]
    if value == "count":
        sums.append(F.sum("count").alias("total"))
    found = hits.groupBy(*key).agg(*sums).where(F.col("matches") >= min_count(discovery_fraction, F.col("n_kmers")))
    rank = F.col("total") if mode == "counts_sum" else F.col("matches")
    if top_n and mode != "labels":
        found = found.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(rank.desc(), "label"))).where(F.col("_r") <= top_n).drop("_r")
    if mode in ("labels", "matches", "counts_sum"):
        return found.select(*key, *{"labels": [], "matches": ["matches", "n_kmers"], "counts_sum": ["total"]}[mode])
    inner = hits.join(found.select(*key), key, "left_semi")
    shown = _shown(mode, inner, key, k)
    return found.select(*key, "matches").join(shown, key)


def in_batches(index: Index, queries: DataFrame, mode: str = "matches", letters: int = 100_000_000, **options) -> DataFrame:
    """The same as ``query``, for batches of queries of about so many letters each, so that each is small enough to go to a stored annotation."""
    sizes = queries.select("query_id", F.char_length("seq").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-total // letters))
    if n > 1 and _scanned(index, queries) and index.mode == "basic" and not options.get("fwd_and_reverse"):  # one pass over the sequences serves all batches
        only = explode_kmers(queries, "seq", index.k, ["query_id"], index.alphabet).select(code("kmer", index.alphabet).alias("kmer")).distinct()
        value = {"counts_sum": "count", "counts": "count", "coords": "coords"}.get(mode)
        with fine_splits(queries.sparkSession):
            index = Index(index.k, index.alphabet, stored=stored(index.found(only, value), "matched"), coded=True)
    out = None
    for i in range(n):
        part = query(index, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i), mode, **options)
        out = part if out is None else out.unionByName(part)
    return out


def aligned_query(graph, index: Index, queries: DataFrame, mode: str = "matches", align_options: dict | None = None, **options) -> DataFrame:
    """Align the queries to a graph first, then query with the sequences of their best paths."""
    from ..operators.align import align

    found = align(graph, queries, **(align_options or {}))
    return query(index, found.select("query_id", F.col("sequence").alias("seq")), mode, **options)


def _shown(mode: str, inner: DataFrame, key: list[str], k: int) -> DataFrame:
    """key and the text that the mode gives for the hits."""
    if mode == "counts":
        return fmt.count_runs(inner.select(*key, "pos", "count"), key, "pos", "count")
    elif mode == "coords":
        return fmt.coordinate_ranges(inner.select(*key, "pos", F.explode("coords").alias("coord")), key, "pos", "coord")
    else:
        at = inner.groupBy(*key).agg(F.max("n_kmers").alias("_n"), F.sort_array(F.collect_set("pos")).alias("_p"))
        # the gaps before, between and after the places become zeros: linear in the length
        gap = lambda n: F.repeat(F.lit("0"), n.cast("int"))
        ones = F.array_join(F.transform("_p", lambda p, i: F.concat(gap(p - F.when(i == 0, F.lit(-1).cast("long")).otherwise(F.get("_p", i - 1)) - 1), F.lit("1"))), "")
        return at.select(*key, F.concat(ones, gap(F.col("_n") - 1 - F.element_at("_p", -1))).alias("bits")).select(*key, fmt.mask_rle("bits").alias("mask"), fmt.mask_score("bits", k).alias("score"))


def by_headers(index: Index, queries: DataFrame, headers: DataFrame, discovery_fraction: float = 0.7, mode: str = "matches", top_n: int | None = None) -> DataFrame:
    """query_id, header and what the mode adds: labels replaced by the sequences that the coordinates fall in; thresholds hold for each.

    A window counts once for a sequence, however often it holds the k-mer; counts and coordinates (local to the sequence) are of all its places.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    windows = explode_kmers(queries.select("query_id", "seq"), "seq", index.k, ["query_id"], index.alphabet)
    if index.coded or _scanned(index, queries):
        windows = windows.withColumn("kmer", code("kmer", index.alphabet))
    rows, _ = _matched(index, windows, queries, "coords")
    spots = rows.select("kmer", F.col("label").alias("file"), F.explode("coords").alias("coord"))
    within = annotation.locate(spots, headers).groupBy("kmer", "file", "seq_no", "header").agg(F.count("*").alias("count"), F.sort_array(F.collect_list("local")).alias("coords"))
    key = ["query_id", "file", "seq_no", "header"]
    hits = windows.join(within, "kmer")
    found = hits.groupBy(*key).agg(F.count("*").alias("matches"), F.max("n_kmers").alias("n_kmers"), F.sum("count").alias("total")).where(F.col("matches") >= min_count(discovery_fraction, F.col("n_kmers")))
    if top_n and mode != "labels":
        rank = F.col("total" if mode == "counts_sum" else "matches")
        found = found.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(rank.desc(), "header", "file", "seq_no"))).where(F.col("_r") <= top_n).drop("_r")
    if mode in ("labels", "matches", "counts_sum"):
        return found.select("query_id", "header", *{"labels": [], "matches": ["matches"], "counts_sum": ["total"]}[mode])
    shown = _shown(mode, hits.join(found.select(*key), key, "left_semi"), key, index.k)
    return found.select(*key, "matches").join(shown, key).drop("file", "seq_no")


def as_tsv(result: DataFrame, value: str = "matches", queries: DataFrame | None = None) -> DataFrame:
    """line: query_id and ``<label>:value`` of its labels, best first; queries without a label are left out unless all ``queries`` are given."""
    each = F.sort_array(F.collect_list(F.struct((-F.col(value)).alias("v"), "label")))
    lines = result.groupBy("query_id").agg(F.array_join(F.transform(each, lambda x: F.concat(F.lit("<"), x.label, F.lit(">:"), (-x.v).cast("string"))), "\t").alias("l"))
    if queries is not None:
        lines = queries.select("query_id").join(lines, "query_id", "left")
    return lines.select(F.concat_ws("\t", F.col("query_id").cast("string"), "l").alias("line"))


def as_json(result: DataFrame, value: str = "matches") -> DataFrame:
    """query_id and json: its results, best first, label properties as objects."""
    each = F.struct((-F.col(value)).alias("o"), F.col("label").alias("l"), F.struct(fmt.label_json("label").alias("label"), F.col(value).alias("kmer_count")).alias("r"))
    return result.groupBy("query_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(each), lambda a, b: F.when(a.o < b.o, -1).when(a.o > b.o, 1).when(a.l < b.l, -1).when(a.l > b.l, 1).otherwise(0)), lambda x: x.r)).alias("json"))
