"""What the training-data operators share: tables, scratch space, token helpers."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import scratch_path, stored

#: The white space of every contract here: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def fold_of(doc_id: int | None, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then runs of anything but SPACES, as UTF-8.

    bytes.lower and bytes.split know only ASCII, which is what the contracts ask for.
    """
    return text.encode().lower().split() if text else []


def row_ids(df: DataFrame, name: str = "uid") -> DataFrame:
    """A number for each row; rows may repeat, so doc_id is no key. Store the result before use."""
    return df.withColumn(name, F.monotonically_increasing_id())


#: Rows of a file whose numbers of copies lie together, and bytes of such numbers that are broadcast at once.
PLACE_ROWS, PLACE_BYTES = 4096, 64 << 20


def placed(docs: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """docs with files to read it from, and ``at`` (file and number of the row in it) with some of its columns.

    A plain read of Parquet is taken as it is; anything else is stored first. So rows
    are named, and later taken again, without a copy of their texts.
    """

    def located(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        return df.select(F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row")).alias("at"), *columns)

    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return docs, located(docs)
        except AnalysisException:  # a read of something else
            pass
    docs = stored(docs, "rows")
    return docs, located(docs)


def taken(docs: DataFrame, copies: DataFrame, at_once: int = PLACE_BYTES) -> DataFrame:
    """The rows of docs (the first of ``placed``), each as often as copies (at, n) says; rows that it lacks go.

    The numbers of copies, a byte a row of a file, are packed by runs of PLACE_ROWS rows and meet the rows
    by a broadcast join, so texts are not shuffled. Where they are more than ``at_once`` bytes, files are dealt
    to waves of so many bytes each, and each wave reads its files only and has its own broadcast.
    """
    runs = copies.where("n > 0").select(F.col("at.file").alias("file"), F.expr(f"at.row div {PLACE_ROWS}").alias("run"), (F.col("at.row") % PLACE_ROWS).cast("int").alias("i"), F.col("n").cast("tinyint").alias("n"))
    each = F.sort_array(F.collect_list(F.struct("i", "n")))
    packed = runs.groupBy("file", "run").agg(each.alias("x")).withColumn("y", F.transform("x", lambda v, j: F.struct(v.n.alias("n"), (v.i - F.when(j > 0, F.get("x", j - 1).i).otherwise(-1) - 1).alias("gap"))))
    zero = F.lit(0).cast("tinyint")
    packed = stored(packed.select("file", "run", F.flatten(F.transform("y", lambda v: F.concat(F.array_repeat(zero, v.gap), F.array(v.n)))).alias("copies")), "copies")
    sizes = packed.groupBy("file").agg(F.sum(F.size("copies") + F.length("file") + 64).alias("b"))
    total = sizes.agg(F.sum("b")).first()[0] or 0
    columns = [F.col(f"`{c}`") for c in docs.columns]
    meta = docs.metadataColumn("_metadata")
    source = docs.select(F.struct(*columns).alias("row"), meta["file_path"].alias("file"), meta["row_index"].alias("place"))

    def wave(rows: DataFrame, some: DataFrame) -> DataFrame:
        keyed = rows.withColumn("run", F.expr(f"place div {PLACE_ROWS}")).join(F.broadcast(some), ["file", "run"])
        times = F.coalesce(F.get("copies", (F.col("place") % PLACE_ROWS).cast("int")), zero).cast("int")
        return keyed.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")

    if total <= at_once:
        return wave(source, packed)
    numbered = sizes.selectExpr("file", f"(sum(b) OVER (ORDER BY file) - b) div {at_once} AS wave")  # a row a file
    files: dict[int, list[str]] = {}
    for x in numbered.collect():
        files.setdefault(x.wave, []).append(x.file)
    out = None
    for some in files.values():
        part = wave(source.where(F.col("file").isin(some)), packed.where(F.col("file").isin(some)))
        out = part if out is None else out.unionByName(part)
    return out


class Shared:
    """A broadcast whose value is pickled with its classes, so executors need no copy of this package."""

    def __init__(self, spark: SparkSession, value):
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return pickle.loads(self.held.value)


#: Bytes of text that a worker unpacks at once; a longer text comes alone.
SLICE_BYTES = 2 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in parts of about ``size`` bytes of text, so memory does not follow the batches' row counts."""
    for b in batches:
        if not b.num_rows:
            continue
        part = np.cumsum(pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield b.slice(lo, hi - lo)
