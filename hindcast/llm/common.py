"""Helpers shared by the training-data operators: scratch tables in the
cluster's shared folder, file access from tasks, and column names that cannot
clash with the caller's."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.session import checkpoint_dir

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2048
WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the cluster's checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Batches that go to Python tasks hold at most ``most`` rows in the jobs
    that start in here."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(int(before), most) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


#: Parquet options for rows of some MB each: a row group per row. A writer
#: would gather a hundred rows before it looks at their size, and a reader and
#: the batches behind it hold the rows of a row group together.
LARGE_ROWS = {"parquet.block.row.count.limit": "1", "parquet.page.size.row.check.min": "1"}


def materialize(df: DataFrame, label: str, rows: int = BATCH_ROWS, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the plan
    above starts from files that outlive any executor. Batches that go to Python
    tasks hold at most ``rows`` rows meanwhile, fewer than usual, as texts may
    be long."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with arrow_rows(spark, rows):
        df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


_MODEL: list = [None, None]


def worker_model(key: Hashable, build: Callable[[], object]):
    """The large model that this worker process works with, built when first
    asked for. A worker serves many stages; it keeps the model of the last one
    only."""
    if _MODEL[0] != key:
        _MODEL[:] = [None, None]
        _give_back()
        _MODEL[:] = [key, build()]
        _give_back()
    return _MODEL[1]


def _give_back() -> None:
    """Hand memory that this process has freed back to the system, so that a
    stage does not add to what the stages before it needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`materialize`."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hpath, True)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, prefixed until no column of ``df`` has that name (compared
    without case, as Spark resolves names)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def columns_of(names: list[str]) -> list[Column]:
    """Columns by their exact names, dots included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def boxed(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns as one struct column ``row``, so that tasks hand them
    on whatever they are called."""
    return df.select(F.struct(*columns_of(names)).alias("row"))


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path for a URI, as a task sees it. Folders shared by
    mount need no scheme; other stores are opened by Arrow's connectors."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    return pafs.FileSystem.from_uri(uri)
