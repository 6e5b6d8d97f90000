"""A facade with the verbs of a search service: search, align, column labels, stats; one or many indexes by name."""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import label_json
from ..operators import align as aln
from ..operators.graph import KmerGraph
from ..sources.readers import read_string
from .query import Index, query

TOP_LABELS = 10_000
#: More indexes than this need names to be chosen from.
MOST_UNNAMED = 10


class BadRequest(ValueError):
    """What a server would answer with status 400."""


def mode_of(with_signature: bool = False, abundance_sum: bool = False, query_counts: bool = False, query_coords: bool = False) -> str:
    """Coordinates before counts before signatures before sums before matches."""
    for asked, mode in ((query_coords, "coords"), (query_counts, "counts"), (with_signature, "signature"), (abundance_sum, "counts_sum")):
        if asked:
            return mode
    return "matches"


@dataclass
class Service:
    """indexes: name to the indexes that answer for it; graphs: name to a graph to align to."""

    spark: SparkSession
    indexes: dict[str, list[Index]] = field(default_factory=dict)
    graphs: dict[str, KmerGraph] = field(default_factory=dict)

    def _chosen(self, names: list[str] | None) -> list[tuple[str, Index]]:
        if names is None and len(self.indexes) > MOST_UNNAMED:
            raise BadRequest("too many graphs: name those to search")
        unknown = set(names or ()) - self.indexes.keys()
        if unknown:
            raise BadRequest(f"no such graph: {', '.join(sorted(unknown))}")
        return [(n, i) for n in (names or self.indexes) for i in self.indexes[n]]

    def queries(self, sequence: str | list[str]) -> DataFrame:
        """query_id, name and seq of a sequence, of a FASTA text or of a list of sequences."""
        text = sequence if isinstance(sequence, str) else "".join(f">{i}\n{s}\n" for i, s in enumerate(sequence))
        if not text.strip():
            raise BadRequest("no sequence")
        return read_string(self.spark, text if text.lstrip().startswith(">") else f">query\n{text}").select(F.col("seq_no").alias("query_id"), "name", "seq")

    def search(self, sequence: str | list[str], top_labels: int = TOP_LABELS, discovery_fraction: float = 0.7, graphs: list[str] | None = None, **flags: bool) -> DataFrame:
        """graph, query_id, label and what the mode gives, of all chosen indexes."""
        if not 0 <= discovery_fraction <= 1:
            raise BadRequest("discovery_fraction must be within 0 and 1")
        queries, out = self.queries(sequence), None
        for name, index in self._chosen(graphs):
            found = query(index, queries, mode_of(**flags), discovery_fraction, top_n=top_labels).withColumn("graph", F.lit(name))
            out = found if out is None else out.unionByName(found, allowMissingColumns=True)
        return out

    def search_pandas(self, sequence: str | list[str], **options) -> pd.DataFrame:
        """The same as pandas, with label properties as columns."""
        found = self.search(sequence, **options).withColumn("_j", label_json("label"))
        df = found.withColumn("sample", F.col("_j.sample")).withColumn("properties", F.to_json("_j.properties")).drop("_j").toPandas()
        properties = df.pop("properties").map(lambda x: pd.read_json(x, typ="series").to_dict() if x and x != "{}" else {})
        return df.join(pd.DataFrame(properties.tolist(), index=df.index))

    def search_async(self, sequences: list[str], workers: int = 4, **options) -> list[Future]:
        """A future with rows for each sequence; Spark runs their jobs side by side."""
        pool = ThreadPoolExecutor(workers)
        out = [pool.submit(lambda s=s: self.search(s, **options).collect()) for s in sequences]
        pool.shutdown(wait=False)
        return out

    def align(self, sequence: str | list[str], graph: str, both_strands: bool = False, **options) -> DataFrame:
        if graph not in self.graphs:
            raise BadRequest(f"no such graph: {graph}")
        return (aln.align_both_strands if both_strands else aln.align)(self.graphs[graph], self.queries(sequence).select("query_id", "seq"), **options)

    def column_labels(self, graphs: list[str] | None = None) -> DataFrame:
        out = None
        for name, index in self._chosen(graphs):
            rows = index.stored if index.stored is not None else index.sequences
            labels = rows.select(F.lit(name).alias("graph"), "label").distinct()
            out = labels if out is None else out.unionByName(labels)
        return out

    def stats(self, name: str) -> dict:
        index = self._chosen([name])[0][1]
        labels = self.column_labels([name]).count()
        return {"graph": {"k": index.k, "mode": index.mode, "alphabet": index.alphabet.name}, "annotation": {"labels": labels}}
