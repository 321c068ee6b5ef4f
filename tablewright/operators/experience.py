"""Fixes that helped, what is known for a new case, and the candidate rule to take."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recorded(fixes: DataFrame) -> DataFrame:
    """code, field, fix, hits, first, last of fixes (id, code, field, fix): one row for each that was applied to a report's field, counted."""
    return fixes.groupBy("code", "field", "fix").agg(F.count("*").alias("hits"), F.min("id").alias("first"), F.max("id").alias("last"))


def known_fix(cases: DataFrame, known: DataFrame) -> DataFrame:
    """Each case (code, field) with the fix to try and its source: exact, the first that was recorded for this code and field; else field, that
    with most hits for the field (the first recorded of equals); else null. Two lookups by key; fields are few, so the second table is small."""
    own = known.groupBy("code", "field").agg(F.min_by("fix", "first").alias("own"))
    common = known.groupBy("field").agg(F.min_by("fix", F.struct(-F.col("hits"), "first")).alias("common"))
    j = cases.join(own, ["code", "field"], "left").join(common, "field", "left")
    return j.select("code", "field", F.coalesce("own", "common").alias("fix"), F.when(F.col("own").isNotNull(), "exact").when(F.col("common").isNotNull(), "field").alias("source"))


def top_fixes(known: DataFrame, most: int = 5) -> DataFrame:
    """The fixes that were needed more than once, most hits first, the first recorded of equals: rank, code, field, fix, hits."""
    top = known.where("hits > 1").orderBy(F.desc("hits"), "first").limit(most)
    return top.select(F.row_number().over(Window.orderBy(F.desc("hits"), "first")).alias("rank"), "code", "field", "fix", "hits")


def accepted(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each candidate of ``after`` (code, candidate, passed, red_count, red_fields) with accept or reject against ``before`` (without candidate): never if a
    report that passed doesn't any more or a field is red that wasn't; else if it passes now and didn't, or has fewer reds."""
    b = before.select("code", F.col("passed").alias("_p"), F.col("red_count").alias("_n"), F.col("red_fields").alias("_f"))
    new = F.size(F.array_except("red_fields", "_f")) > 0
    worse = (F.col("_p") & ~F.col("passed")) | new
    better = (~F.col("_p") & F.col("passed")) | (F.col("red_count") < F.col("_n"))
    return after.join(b, "code").withColumn("outcome", F.when(~worse & better, "accept").otherwise("reject")).drop("_p", "_n", "_f")


def best_candidate(judged: DataFrame) -> DataFrame:
    """code, evaluated, accepted and candidate: of a report's accepted candidates that with fewest reds, the first of equals; null if none is."""
    ok = F.when(F.col("outcome") == "accept", F.struct("red_count", "candidate"))
    return judged.groupBy("code").agg(F.count("*").alias("evaluated"), F.min_by("candidate", ok).alias("candidate")).select("code", "evaluated", F.col("candidate").isNotNull().alias("accepted"), "candidate")
