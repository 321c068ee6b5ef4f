"""Ledgers as append-only event logs: the state is the latest event of each key.

All states come from one aggregate by key (max_by over a sequence number), so an upsert is an
append and a read costs one shuffle of narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, keys: tuple[str, ...], seq: str, values: tuple[str, ...]) -> DataFrame:
    return events.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(seq)).alias("_s")).select(*keys, "_s.*")


def triage_state(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Latest reason and status; created_at is the first time, updated_at the last, reopening allowed."""
    return events.groupBy(*keys).agg(F.max_by(F.struct("reason", "status"), "seq").alias("s"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count("*").alias("n_events")).select(*keys, "s.reason", "s.status", "created_at", "updated_at", "n_events")


def upsert_keep(runs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Automatic columns from the last run; a human verdict stays once given, the last one given wins."""
    return runs.groupBy(*keys).agg(F.max_by("auto", "seq").alias("auto"), F.max_by("verdict", F.when(F.col("verdict").isNotNull(), F.col("seq"))).alias("verdict"))


def timeline(events: DataFrame, keys: tuple[str, ...], most: int = 20) -> DataFrame:
    """The first events of each key's latest run, in order."""
    last = events.groupBy(*keys).agg(F.max_by("run_id", "id").alias("run_id"))
    w = Window.partitionBy(*keys).orderBy("id")
    return events.join(last, [*keys, "run_id"], "left_semi").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def overlay(base: DataFrame, patch: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Base rows with patched values; only keys that the base has."""
    p = patch.select(*keys, F.col(value).alias("_patch"))
    return base.join(p, list(keys), "left").withColumn(value, F.coalesce("_patch", value)).drop("_patch")


def by_priority(candidates: DataFrame, keys: tuple[str, ...], priority: Column, values: tuple[str, ...]) -> DataFrame:
    """Of candidates from several sources the one with the least priority."""
    return candidates.groupBy(*keys).agg(F.min_by(F.struct(*values), priority).alias("_s")).select(*keys, "_s.*")


def append_lines(rows: DataFrame, folder: str) -> None:
    """Add rows to a folder of JSON lines; each task writes a file of its own."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(folder)


def read_lines(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, dead letters) of a column ``line`` of JSON lines: a line that isn't an object of the schema, as one cut off by a
    stop, is a dead letter and doesn't end the reading."""
    parsed = lines.select("line", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    bad = F.col("x").isNull() | F.col("x._bad").isNotNull()
    return parsed.where(~bad).select("x.*").drop("_bad"), parsed.where(bad).select("line")


def ensure_copy(source: str, target: str, spark) -> bool:
    """A test table: a copy of the source where the target doesn't exist yet. Whether it was made; an error if both are one."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("a test table can't be its own source")
    where = spark._jvm.org.apache.hadoop.fs.Path(target)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return False
    spark.read.parquet(source).write.mode("ignore").parquet(target)
    return True
