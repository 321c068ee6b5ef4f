"""Predictions against golden breakdowns, leaderboards and acceptance of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.text import normal_name

REPORT = ("code", "year")


def last_per_name(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Normalised names; of rows that share one the last (by idx) counts."""
    rows = rows.withColumn("nname", normal_name(F.col("name")))
    return rows.groupBy(*by, "nname").agg(F.max_by("amount", F.struct("idx", "amount")).alias("amount"))


def matches(golden: DataFrame, pred: DataFrame, by: tuple[str, ...] = ("version", *REPORT, "dim")) -> DataFrame:
    """Full outer join by normalised name: golden and predicted amount, and whether they agree."""
    g = last_per_name(golden, by).select(*by, "nname", F.col("amount").cast("double").alias("g"), F.lit(True).alias("has_g"))
    p = last_per_name(pred, by).select(*by, "nname", F.col("amount").cast("double").alias("p"), F.lit(True).alias("has_p"))
    same = (F.col("g").isNull() & F.col("p").isNull()) | F.coalesce(F.abs(F.col("g") - F.col("p")) <= 0.01 * F.greatest(F.abs("g"), F.abs("p"), F.lit(1.0)), F.lit(False))
    both = F.coalesce("has_g", F.lit(False)) & F.coalesce("has_p", F.lit(False))
    return g.join(p, [*by, "nname"], "full_outer").withColumn("matched", both).withColumn("agree", both & same)


def score_dimensions(golden: DataFrame, pred: DataFrame, by: tuple[str, ...] = ("version", *REPORT, "dim")) -> DataFrame:
    """Recall, precision and value accuracy of each dimension; empty sides count as 1 if both
    are empty and as 0 otherwise."""
    n = matches(golden, pred, by).groupBy(*by).agg(
        F.count("has_g").alias("n_golden"), F.count("has_p").alias("n_pred"), F.count_if("matched").alias("n_matched"), F.count_if("agree").alias("n_agree")
    )
    share = lambda a, b, other: F.when(F.col(b) > 0, F.col(a) / F.col(b)).when(F.col(other) > 0, 0.0).otherwise(1.0)
    return n.select(
        *by, "n_golden", "n_pred", share("n_matched", "n_golden", "n_pred").alias("row_recall"), share("n_matched", "n_pred", "n_golden").alias("row_precision"),
        F.when(F.col("n_matched") > 0, F.col("n_agree") / F.col("n_matched")).when(F.col("n_golden") + F.col("n_pred") > 0, 0.0).otherwise(1.0).alias("value_acc"),
        (F.col("n_golden") + F.col("n_pred") - F.col("n_matched") - F.col("n_agree")).alias("n_mismatch"),
    )


def score_fields(golden: DataFrame, pred: DataFrame) -> DataFrame:
    """One score for each version and report, over the dimensions that are labelled."""
    dims = score_dimensions(golden, pred).where("n_golden > 0")
    s = dims.groupBy("version", *REPORT).agg(F.avg(F.col("row_recall") * F.col("value_acc")).alias("rv"), F.avg("row_precision").alias("pr"), F.sum("n_mismatch").alias("n_mismatch"))
    score = F.round(F.col("rv") * F.col("pr"), 4)
    return s.select("version", *REPORT, score.alias("score"), ((score >= 0.999) & (F.col("n_mismatch") == 0)).alias("exact"))


def score_with_total(golden: DataFrame, pred: DataFrame, golden_total: DataFrame, pred_total: DataFrame) -> DataFrame:
    """Details of one dimension and a total that counts as one more item."""
    by = ("version", *REPORT)
    n = matches(golden, pred, by).groupBy(*by).agg(F.count("has_g").alias("n_golden"), F.count("has_p").alias("n_pred"), F.count_if("agree").alias("n_agree"))
    t = golden_total.withColumnRenamed("total", "gt").join(pred_total.withColumnRenamed("total", "pt"), list(by))
    g, p = F.col("gt").cast("double"), F.col("pt").cast("double")
    hit = (F.abs(g - p) <= 0.01 * F.greatest(F.abs(g), F.abs(p), F.lit(1.0))).cast("int")
    return n.join(t, list(by)).select(*by, F.round((F.col("n_agree") + hit) / (F.greatest("n_golden", "n_pred") + 1), 4).alias("score"))


def evaluate(scores: DataFrame) -> DataFrame:
    return scores.groupBy("version").agg(F.count("*").alias("n"), F.count_if("exact").alias("exact"), F.round(F.avg("score"), 4).alias("mean_score"))


def leaderboard(scores: DataFrame) -> DataFrame:
    """Versions ranked by mean score, then exact reports; a row for each version, so one task ranks them."""
    e = evaluate(scores)
    return e.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_score"), F.desc("exact"), "version")))


def best_version(scores: DataFrame) -> DataFrame:
    """The best version of each report, the first in order on ties."""
    return scores.groupBy(*REPORT).agg(F.max_by(F.struct("version", "score"), F.struct("score", -F.col("ord"))).alias("b")).select(*REPORT, "b.version", "b.score")


def accept(scores: DataFrame, base: str, candidate: str) -> DataFrame:
    """A candidate is accepted if its mean gains and no report loses."""
    a = scores.where(F.col("version") == base).select(*REPORT, F.col("score").alias("a"))
    b = scores.where(F.col("version") == candidate).select(*REPORT, F.col("score").alias("b"))
    n = a.join(b, list(REPORT)).agg(F.count("*").alias("n"), F.round(F.avg("a"), 4).alias("base_mean"), F.round(F.avg("b"), 4).alias("cand_mean"), F.count_if(F.col("b") < F.col("a") - 1e-9).alias("regressions"), F.avg(F.col("b") - F.col("a")).alias("gain"))
    return n.select(F.lit(candidate).alias("candidate"), "n", "base_mean", "cand_mean", "regressions", ((F.col("gain") > 1e-6) & (F.col("regressions") == 0)).alias("accepted"))
