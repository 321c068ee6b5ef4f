"""A vector index of inverted lists: every row stands in the list of its nearest centre, a query looks into the lists nearest to it, and what
it finds there is ranked by the exact cosine.

Centres are fitted on a bounded sample (``sample`` rows, least hashes first); all rows are indexed. A list of many rows is
split into portions, which the queries that probe it visit one by one, so that a hot list is no task's alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.selection import cosine
from tablewright.session import kept

#: Rows of a list that one portion holds, about.
PORTION = 8192


@dataclass
class Index:
    """rows: vec_id, embedding, list, portion, written to the shared folder; sizes: a row for each list; centres: unit vectors."""

    rows: DataFrame
    sizes: DataFrame
    centres: np.ndarray


def units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def fitted(vectors: DataFrame, lists: int, sample: int = 16384, rounds: int = 10) -> np.ndarray:
    """Centres by spherical k-means over at most ``sample`` rows, those with the least hashes; fewer rows than lists are centres themselves."""
    some = vectors.where("embedding is not null").select("embedding", F.xxhash64("vec_id").alias("h")).orderBy("h", "embedding").limit(sample).collect()
    x = units(np.array([r["embedding"] for r in some], np.float64)) if some else np.zeros((0, 1))
    if len(x) <= lists:
        return x
    centres = x[np.linspace(0, len(x) - 1, lists).astype(int)]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        empty = np.bincount(nearest, minlength=lists) == 0
        centres = np.where(empty[:, None], centres, units(sums))
    return centres


def nearest_lists(centres: np.ndarray, many: int):
    """A function from vectors to their ``many`` nearest lists; one to several numbers for each vector."""

    @F.pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        at = np.argsort(-(np.array(v.tolist(), np.float64) @ centres.T), axis=1, kind="stable")[:, :many]
        return pd.Series(list(at.astype(np.int32)))

    return near


def build(vectors: DataFrame, lists: int | None = None, sample: int = 16384) -> Index:
    """The index of (vec_id, embedding). ``lists`` is the square root of the number of rows at most 4,096 unless it is given. Null vectors have no
    list, as they are like nothing; ids may repeat."""
    rows = vectors.where("embedding is not null").select("vec_id", "embedding")
    lists = lists or int(min(4096, max(1, rows.count() ** 0.5)))
    centres = fitted(rows, lists, sample)
    if not len(centres):
        return Index(rows.withColumn("list", F.lit(0)).withColumn("portion", F.lit(0)), rows.select(F.lit(0).alias("list"), F.lit(1).alias("portions")).limit(0), centres)
    dealt = kept(rows.withColumn("list", nearest_lists(centres, 1)("embedding")[0]), "lists")
    sizes = dealt.groupBy("list").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("portions"))  # no more rows than centres
    cut = dealt.join(F.broadcast(sizes), "list").withColumn("portion", F.pmod(F.xxhash64("vec_id"), F.col("portions")).cast("int")).drop("portions")
    return Index(cut, sizes, centres)


def search(index: Index, queries: DataFrame, top: int, threshold: float, probes: int, itself: bool = True) -> DataFrame:
    """qid, vec_id, score and rank: for each query (qid, q) of a stated set the ``top`` rows by cosine, at or above the
    threshold, of the ``probes`` lists nearest to it. Without ``itself`` a row with the query's own id is left out."""
    if not len(index.centres):
        return queries.select("qid", F.lit(None).cast("bigint").alias("vec_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")).limit(0)
    asked = queries.where("q is not null").withColumn("list", F.explode(nearest_lists(index.centres, probes)("q")))
    asked = asked.join(F.broadcast(index.sizes), "list").withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1))).drop("portions")
    found = index.rows.join(asked, ["list", "portion"])
    if not itself:
        found = found.where("vec_id <> qid")
    found = found.select("qid", "vec_id", "list", "portion", cosine(F.col("embedding"), F.col("q")).alias("sim")).where(F.col("sim") >= threshold)
    order = [F.desc("sim"), "vec_id"]
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "list", "portion").orderBy(*order))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("qid", "vec_id", F.round("sim", 4).alias("score"), "rank")


def semantic_checks(queries: DataFrame, found: DataFrame, least: float = 0.6) -> DataFrame:
    """qid, similarity (of the nearest; 0 without one), passed and suggest of each query: what is less like all that is known than ``least`` calls for a
    new parser."""
    best = found.groupBy("qid").agg(F.max("score").alias("similarity"))
    s = queries.select("qid").join(best, "qid", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    return s.select("qid", "similarity", (F.col("similarity") >= least).alias("passed"), F.when(F.col("similarity") >= least, "pass").otherwise("new_parser").alias("suggest"))
