"""Helpers shared by the corpus operators: shared folders, lineage cuts, Arrow mapping, folds."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the setting is absent, a local session gets a
    temporary one; a cluster doesn't, as its executors don't share the driver's disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tablewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """The URI of a folder of its own for one run, in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from files in the shared folder: later jobs neither repeat the
    work above nor depend on the executors that did it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """The same rows, written to the shared folder as columns and read from there."""
    df.write.parquet(path := new_folder(df.sparkSession, what))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(file system, path) of a URI as executors see it; a bare path is local."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


#: Rows and bytes of an Arrow batch on its way to or from a Python worker: whole texts travel in them.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to the bounds above; a lower setting of the caller's stays."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        digits = (now or "").rstrip("bB")
        if not digits.isdigit() or not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Give memory that a task no longer uses back to the machine: its worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to trim


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[list[list]], list[list]]]) -> DataFrame:
    """mapInArrow with plain lists. make() runs once in each task and gives a function from
    the input columns of one batch to the output columns, in the order of ``schema``. If that has
    an attribute ``end``, it's called when the task is over."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    bound_batches(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH_ROWS):
                    columns = work([c.to_pylist() for c in batch.slice(at, BATCH_ROWS).columns])
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out)
        finally:
            getattr(work, "end", int)()
            release()

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
