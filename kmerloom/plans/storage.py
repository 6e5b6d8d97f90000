"""Tables that cut lineage: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: For each scratch() that is entered, the paths that were handed out since.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, as in tests, may lack it; it then gets a temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="kmerloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/kmerloom/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    deleted(df.sparkSession, *{x.rpartition("/")[0] for x in df.inputFiles()})


#: Bytes of files that a task reads where its work on them is heavy.
SPLIT_BYTES = 32 << 20


@contextmanager
def fine_splits(spark: SparkSession) -> Iterator[None]:
    """What is executed within reads files in parts of up to SPLIT_BYTES, so that cores end at about the same time; the session's own bound returns at the end."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    if spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() > SPLIT_BYTES:
        spark.conf.set(name, f"{SPLIT_BYTES}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored within are deleted at the end: what is to stay must be written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        deleted(spark, *_scopes.pop())
