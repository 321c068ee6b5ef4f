"""Session helpers shared by tests, the benchmark and interactive use."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "tablewright", **conf: str) -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(conf.pop("shuffle_partitions", cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TABLEWRIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.python.filterPushdown.enabled", "true")  # the table cache's reader filters file names
    )
    for key, value in conf.items():
        b = b.config(key, value)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share. Where the setting is absent, a
    local session gets a temporary one; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tablewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: How many times as large as its files a table is taken to be where a plan is chosen.
FILE_FACTOR = 1000.0


def cautious(spark: SparkSession) -> None:
    """Files with runs of equal keys are some hundred times smaller than their rows, and a plan that goes by the files'
    size broadcasts what the driver can't hold. With sizes taken for larger the choice is left to adaptive execution, which
    broadcasts what has turned out to be small. A larger factor that the session has stays. What is dealt by report may be joined
    by report and table without a further shuffle, as a report has few tables."""
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor", "1")) < FILE_FACTOR:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(FILE_FACTOR))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a write go as soon as it is done, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, path: str) -> None:
    """Write rows to a folder as parquet."""
    with swept(df.sparkSession):
        df.write.parquet(path)


def kept(df: DataFrame, what: str) -> DataFrame:
    """The same rows, read from files of their own in the shared folder."""
    written(df, path := f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
