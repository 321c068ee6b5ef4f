"""What a run knows of its failures, layer by layer, and the rates of its outcomes by field.

Each layer is a probe over all reports, keyed by (code, year); a dossier joins them for the reports that failed, and the
first layer that gave way names the failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.operators import routing
from tablewright.operators.grid import TABLE
from tablewright.operators.reconcile import near

REPORT = ["code", "year"]
#: Words that a table of dimensions has, and the rows of data that show that it was extracted whole.
MARKERS = ("分行业", "分产品", "分地区", "分销售", "按行业", "按产品", "按地区")
DATA_ROWS = 3
#: Outcomes, those that count as success, and those that a rate is a share of (with the first two).
OUTCOMES = ("green", "committed", "verify_hold", "non_green", "no_data", "no_anchor", "no_such_table", "out_of_scope")
SUCCESS, DENOMINATOR = OUTCOMES[:2], OUTCOMES[:5]


def extraction_probe(cells: DataFrame) -> DataFrame:
    """code, year, n_marked (tables with a marker) and extracted (one of them has three rows with both a digit and a text at
    least). Reports without such a table are absent. Markers may stand in any cell."""
    v = F.col("v")
    any_ = lambda test: F.bool_or(F.coalesce(test, F.lit(False)))
    rows = cells.groupBy(*TABLE, "r").agg(any_(v.rlike("[0-9]")).alias("digit"), any_(T.is_text(v)).alias("text"), any_(v.rlike("|".join(MARKERS))).alias("marked"))
    tables = rows.groupBy(*TABLE).agg(F.count_if(F.col("digit") & F.col("text")).alias("n"), F.bool_or("marked").alias("marked")).where("marked")
    return tables.groupBy(*REPORT).agg(F.count("*").alias("n_marked"), F.bool_or(F.col("n") >= DATA_ROWS).alias("extracted"))


def parse_probe(items: DataFrame, anchors: DataFrame) -> DataFrame:
    """code, year, n_dims, n_hit (dimensions that meet the anchor or the main-business one within 3 %) and known (there is an anchor)."""
    dims = items.where("dim is not null").groupBy(*REPORT, "dim").agg(F.sum(F.col("amount").cast("decimal(20,2)")).alias("s"))
    j = dims.join(anchors.select(*REPORT, "revenue", "main_revenue"), REPORT, "left")
    hit = near(F.col("s"), F.col("revenue"), 0.03) | near(F.col("s"), F.col("main_revenue"), 0.03)
    return j.groupBy(*REPORT).agg(F.count("*").alias("n_dims"), F.count_if(F.coalesce(hit, F.lit(False))).alias("n_hit"))


def dossiers(failed: DataFrame, chosen: DataFrame, extraction: DataFrame, parsed: DataFrame, anchors: DataFrame) -> DataFrame:
    """The probes of all ``failed`` reports (code, year), with the layer that gave way: extraction (the data are in no table),
    anchor (nothing to hold a table against), selection (the chosen table misses the anchor by more than 5 %), parse (a dimension
    misses it), else data. ``chosen``: code, year, table_id, rel, via. A report without a probe's row counts as nothing found."""
    known = anchors.where("revenue is not null and revenue <> 0").select(*REPORT, F.lit(True).alias("known"))
    j = failed.select(*REPORT).join(chosen.select(*REPORT, "table_id", "rel", "via"), REPORT, "left").join(extraction, REPORT, "left").join(parsed, REPORT, "left").join(known, REPORT, "left")
    j = j.withColumns({"n_marked": F.coalesce("n_marked", F.lit(0)), "extracted": F.coalesce("extracted", F.lit(False)), "n_dims": F.coalesce("n_dims", F.lit(0)), "n_hit": F.coalesce("n_hit", F.lit(0)), "anchor_matches": F.coalesce(F.col("rel") <= 0.05, F.lit(False))})
    layer = F.when(~F.col("extracted"), "extraction").when(F.col("known").isNull(), "anchor").when(~F.col("anchor_matches"), "selection").when((F.col("n_dims") == 0) | (F.col("n_hit") < F.col("n_dims")), "parse").otherwise("data")
    return j.select(*REPORT, "table_id", "via", "rel", "anchor_matches", "n_marked", "extracted", "n_dims", "n_hit", layer.alias("layer"))


def outcomes(reports: DataFrame, judged: DataFrame, verdicts: DataFrame, names: DataFrame) -> DataFrame:
    """field, code, year, outcome of every report and field. ``judged``: routing.plausibility; ``verdicts`` (code, year, verdict) and
    ``names`` (code, year, name) may lack reports. Companies that report by other rules are out of scope for revenue; a report
    without a candidate has no data; clean candidates are green until a verdict commits or holds them."""
    fields = F.explode(F.array(*map(F.lit, routing.CLASSES))).alias("field")
    j = reports.select(*REPORT, fields).join(routing.best(judged), ["field", *REPORT], "left").join(verdicts.select(*REPORT, "verdict"), REPORT, "left").join(names.select(*REPORT, "name"), REPORT, "left")
    clean, v = F.coalesce("clean", F.lit(False)), F.col("verdict")
    o = F.when(T.out_of_scope(F.col("name"), F.col("field")), "out_of_scope").when(F.col("n_tried").isNull(), "no_data").when(clean & (v == "pass"), "committed").when(clean & (v == "hold"), "verify_hold").when(clean, "green")
    o = o.when(v == "wrong_table", "no_such_table").when(F.col("confidence") == "unknown", "no_anchor").otherwise("non_green")
    return j.select("field", *REPORT, o.alias("outcome"))


def rates(outcomes: DataFrame) -> DataFrame:
    """Counts of all outcomes, the denominator (success, holds, failures and missing data) and the rate to three places, for each
    field and overall, in one pass. The rate is null where the denominator is 0; without rows only overall remains."""
    n = lambda names: F.count_if(F.col("outcome").isin(*names))
    r = outcomes.rollup("field").agg(*(n((o,)).alias(o) for o in OUTCOMES), n(DENOMINATOR).alias("anchored_denominator"), n(SUCCESS).alias("_ok"))
    return r.select(F.coalesce("field", F.lit("overall")).alias("field"), *OUTCOMES, "anchored_denominator", F.round(F.try_divide("_ok", "anchored_denominator"), 3).alias("success_rate"))
