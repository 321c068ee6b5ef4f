"""Candidates judged by what a run knows, and the best one for each field of each report.

Candidates of all fields and parsers are one table of items, tagged with their source. Judging is a rule for each class of
field; all of them are conditional aggregates of the same two groupings, and the choice is one more.

A  shares of each dimension add up to 97..103, or every dimension meets the anchor within 3 %
B  details add up to the total within 1 %, two of them at least
C  every dimension counts the total, give or take two
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.reconcile import near

#: The class of each field.
CLASSES = {"revenue_breakdown": "A", "cost_breakdown": "A", "rnd_info": "B", "employees": "C"}
KEY = ["field", "code", "year"]
ITEMS = ["field", "source", "ord", "code", "year", "dim", "name", "amount", "ratio"]


def candidates(found: dict[tuple[str, str], DataFrame], first: int = 0) -> DataFrame:
    """One table of what the parsers of each field gave; (field, source) in order of preference, counted from ``first``. Inputs have
    code, year, dim, name and amount, and a ratio where the parser reads shares."""
    tagged = []
    for k, ((field, source), df) in enumerate(found.items(), first):
        ratio = F.col("ratio").cast("double") if "ratio" in df.columns else F.lit(None).cast("double")
        tagged.append(df.where("dim is not null").select(F.lit(field).alias("field"), F.lit(source).alias("source"), F.lit(k).alias("ord"), "code", "year", "dim", "name", F.col("amount").cast("decimal(20,2)").alias("amount"), ratio.alias("ratio")))
    return reduce(DataFrame.unionByName, tagged)


def plausibility(items: DataFrame, truths: DataFrame) -> DataFrame:
    """field, source, ord, code, year, n_rows, n_dims, ok_dims, confidence and clean of each candidate. ``truths`` (field, code, year,
    anchor, main, total) holds what is known of a report; rows and values of it may be missing.

    ok_dims counts dimensions by the class's own rule, confidence is high if all dimensions with a sum meet the anchor (or the
    main-business anchor), low if not, unknown without one. In class A an anchor that is met makes up for shares.
    """
    cls = F.create_map(*(F.lit(x) for kv in CLASSES.items() for x in kv))[F.col("field")]
    dims = items.groupBy(*ITEMS[:6]).agg(F.count("*").alias("n"), F.count("amount").alias("n_amounts"), F.sum("amount").alias("s"), F.round(F.sum("ratio"), 2).alias("shares"))
    j = dims.join(truths, KEY, "left").withColumn("cls", cls)
    s, total = F.col("s").cast("double"), F.col("total").cast("double")
    a_ok = F.coalesce(F.col("shares").between(97, 103), F.lit(False))
    c_ok = F.coalesce((total > 0) & (F.abs(s - total) <= 2), F.lit(False))
    ok = F.when(F.col("cls") == "A", a_ok).when(F.col("cls") == "C", c_ok).otherwise(F.lit(False))
    meets, filled = near(s, F.col("anchor"), 0.03) | near(s, F.col("main"), 0.03), F.coalesce(F.col("s") != 0, F.lit(False))
    whole = F.first("total").cast("double")
    r = j.groupBy(*ITEMS[:5]).agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_dims"), F.count_if(ok).alias("ok_dims"), F.first("cls").alias("cls"),
        F.first("anchor").alias("anchor"), F.count_if(filled).alias("filled"), F.count_if(filled & meets).alias("hits"),
        F.sum(F.when(F.col("dim") != "total", F.col("s"))).cast("double").alias("details"), F.sum(F.when(F.col("dim") != "total", F.col("n_amounts"))).alias("n_details"), whole.alias("total"),
    )
    level = F.when(F.col("anchor").isNull(), "unknown").when((F.col("hits") == F.col("filled")) & (F.col("filled") > 0), "high").otherwise("low")
    sums = (F.col("ok_dims") == F.col("n_dims")) & (F.col("n_rows") >= 2)
    detail = F.coalesce((F.col("total") > 0) & (F.col("n_details") >= 2) & (F.abs(F.col("details") - F.col("total")) <= F.col("total") * 0.01), F.lit(False))
    clean = F.when(F.col("cls") == "B", detail).when(F.col("cls") == "C", F.col("ok_dims") == F.col("n_dims")).otherwise(sums | (level == "high"))
    return r.withColumn("confidence", level).withColumn("clean", clean).select(*ITEMS[:5], "n_rows", "n_dims", "ok_dims", "confidence", "clean")


def best(judged: DataFrame) -> DataFrame:
    """field, code, year, source, clean, confidence, n_tried: of a report's candidates for a field that which is clean, then that with most dimensions in order, then most
    rows, then the first."""
    first = F.max_by(F.struct("source", "clean", "confidence"), F.struct(F.col("clean").cast("int"), "ok_dims", "n_rows", -F.col("ord")))
    return judged.groupBy(*KEY).agg(first.alias("b"), F.count("*").alias("n_tried")).select(*KEY, "b.source", "b.clean", "b.confidence", "n_tried")


def route(judged: DataFrame) -> DataFrame:
    """field, code, year, status, source, n_tried: routed to the best candidate if it is clean; needs_repair, without a source, if none is."""
    clean = F.col("clean")
    return best(judged).select(*KEY, F.when(clean, "routed").otherwise("needs_repair").alias("status"), F.when(clean, F.col("source")).alias("source"), "n_tried")


def routed_items(items: DataFrame, routes: DataFrame) -> DataFrame:
    """The rows of the candidates that were routed to."""
    return items.join(routes.where("status = 'routed'").select(*KEY, "source"), [*KEY, "source"], "left_semi")
