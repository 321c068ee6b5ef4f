"""Reconciliation: group sums against totals, shares and anchors, within tolerances.

All inputs are long: one row for each item of a breakdown. ``keys`` name the report.
Each operator partitions by the report's keys only, and sums are partial on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPORT = ("code", "year")


def shares(items: DataFrame, by: tuple[str, ...] = (*REPORT, "dim"), amount: str = "amount") -> DataFrame:
    """share_calc: percent of the group's sum (2 dp), null for a zero sum; rn: rank by amount."""
    group = Window.partitionBy(*by)
    total = F.sum(amount).over(group).cast("double")
    share = F.round(F.try_divide(F.col(amount).cast("double"), total) * 100, 2)
    return items.withColumn("share_calc", share).withColumn("rn", F.row_number().over(group.orderBy(F.desc(amount), "name")))


def near(value: Column, anchor: Column, tolerance: float) -> Column:
    """Within a relative tolerance of a positive anchor; false for a missing one."""
    v, a = value.cast("double"), anchor.cast("double")
    return F.coalesce((a > 0) & (F.abs(v - a) <= F.lit(tolerance) * a), F.lit(False))


def confidence(items: DataFrame, anchors: DataFrame, tolerance: float = 0.03, anchor: str = "revenue", main: str = "main_revenue") -> DataFrame:
    """One row for each report: n_dims with a non-zero sum, dims_hit (within the tolerance of the anchor
    or of the main-business anchor), confidence (unknown without an anchor, high if all dims
    hit, else low) and parsed_total, the dimension sum farthest from the anchor."""
    sums = items.groupBy(*REPORT, "dim").agg(F.sum("amount").alias("s")).where("s <> 0")
    joined = sums.join(anchors, list(REPORT), "left")
    hit = near(F.col("s"), F.col(anchor), tolerance) | near(F.col("s"), F.col(main), tolerance)
    off = F.abs(F.col("s").cast("double") - F.col(anchor).cast("double"))
    found = joined.groupBy(*REPORT).agg(
        F.count("*").alias("n_dims"),
        F.count_if(hit).alias("dims_hit"),
        F.first(anchor).cast("double").alias(anchor),
        F.first(main).cast("double").alias(main),
        F.max_by(F.col("s").cast("double"), F.struct(off, "dim")).alias("parsed_total"),
    )
    level = F.when(F.col(anchor).isNull(), "unknown").when(F.col("dims_hit") == F.col("n_dims"), "high").otherwise("low")
    return found.withColumn("confidence", level)


def band(total: Column, clean: tuple[float, float], warn: tuple[float, float]) -> Column:
    """clean, warn or red by nested bands."""
    return F.when(total.between(*clean), "clean").when(total.between(*warn), "warn").otherwise("red")


def share_plausibility(items: DataFrame, low: float = 97, high: float = 103) -> DataFrame:
    """A report is clean if each of its dimensions has shares that sum to 97..103 and there are two
    rows or more; ``ratio`` may be missing from rows but not from a whole dimension."""
    dims = items.groupBy(*REPORT, "dim").agg(F.count("*").alias("n"), F.round(F.sum("ratio"), 6).alias("s"))
    ok = F.coalesce(F.col("s").between(low, high), F.lit(False))
    return dims.groupBy(*REPORT).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_dims"), F.count_if(ok).alias("ratio_ok_dims")).withColumn(
        "clean", (F.col("ratio_ok_dims") == F.col("n_dims")) & (F.col("n_rows") >= 2)
    )


def detail_plausibility(items: DataFrame, totals: DataFrame, percent: float = 1.0) -> DataFrame:
    """Details against a total: clean with two amounts or more and a difference of at most ``percent``."""
    sums = items.groupBy(*REPORT).agg(F.count("amount").alias("n_rows"), F.sum("amount").alias("s"))
    total, s = F.col("total").cast("double"), F.coalesce("s", F.lit(0)).cast("double")
    diff = F.round(F.abs(s - total) / F.when(total > 0, total) * 100, 4)
    return totals.join(sums, list(REPORT), "left").select(
        *REPORT, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), diff.alias("diff_pct"),
        F.coalesce((total > 0) & (F.col("n_rows") >= 2) & (diff <= percent), F.lit(False)).alias("clean"),
    )


def count_plausibility(items: DataFrame, totals: DataFrame, slack: int = 2) -> DataFrame:
    """Head counts against a total: every dimension within ``slack``, one dimension at least."""
    dims = items.groupBy(*REPORT, "dim").agg(F.sum("n").alias("s"))
    j = totals.join(dims, list(REPORT), "left")
    return j.groupBy(*REPORT).agg(F.count("dim").alias("n_dims"), F.count_if(F.abs(F.col("s") - F.col("total")) <= slack).alias("ok_dims"), F.first("total").alias("total")).withColumn(
        "clean", (F.col("total") > 0) & (F.col("n_dims") > 0) & (F.col("ok_dims") == F.col("n_dims"))
    )


def violations_of_shares(items: DataFrame, field: str) -> DataFrame:
    """Share rules: a share outside 0..100 is red; three shares or more that sum outside 98..102
    warn, outside 90..110 are red."""
    bad = ~F.col("ratio").between(0, 100)
    rows = items.where(F.col("ratio").isNotNull())
    single = rows.where(bad).select(*REPORT, F.concat(F.lit(field + "."), "dim").alias("field"), F.lit("ratio_range").alias("rule"), F.lit("red").alias("severity"), F.col("name").alias("detail"))
    sums = rows.where(~bad).groupBy(*REPORT, "dim").agg(F.count("*").alias("n"), F.round(F.sum("ratio"), 2).alias("s")).where("n >= 3")
    level = band(F.col("s"), (98, 102), (90, 110))
    summed = sums.select(*REPORT, F.concat(F.lit(field + "."), "dim").alias("field"), F.lit("ratio_sum").alias("rule"), level.alias("severity"), F.format_number("s", 2).alias("detail")).where("severity <> 'clean'")
    return single.unionByName(summed)


def violations_of_total(items: DataFrame, totals: DataFrame, field: str, clean: float, warn: float, relative: bool) -> DataFrame:
    """Sum of details against a total, in percent of it or in absolute numbers."""
    sums = items.groupBy(*REPORT).agg(F.sum("amount").alias("s"))
    j = totals.join(sums, list(REPORT))
    total, s = F.col("total").cast("double"), F.col("s").cast("double")
    off = F.round(F.abs(s - total) / F.when(total > 0, total) * 100, 2) if relative else F.abs(s - total)
    level = F.when(total < 0, "red").when(total == 0, "clean").otherwise(band(off, (0, clean), (0, warn)))
    return j.select(*REPORT, F.lit(field).alias("field"), F.when(total < 0, "negative").otherwise("detail_sum").alias("rule"), level.alias("severity"), F.format_number(off.cast("double"), 2).alias("detail")).where("severity <> 'clean'")


def hard_rules(reports: DataFrame, *violations: DataFrame) -> DataFrame:
    """Roll-up for each report; one without violations passes."""
    v = violations[0]
    for x in violations[1:]:
        v = v.unionByName(x)
    # red fields go with their counts: names gathered for one report are few
    counts = v.groupBy(*REPORT).agg(
        F.count_if(F.col("severity") == "red").alias("red_count"),
        F.count_if(F.col("severity") == "warn").alias("warn_count"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("severity") == "red", F.split("field", r"\.")[0]))), ",").alias("red_fields"),
    )
    return reports.select(*REPORT).join(counts, list(REPORT), "left").select(
        *REPORT, F.coalesce("red_count", F.lit(0)).alias("red_count"), F.coalesce("warn_count", F.lit(0)).alias("warn_count"),
        F.coalesce("red_fields", F.lit("")).alias("red_fields"), (F.coalesce("red_count", F.lit(0)) == 0).alias("passed"),
    )


def unit_rescue(breakdown: DataFrame, anchors: DataFrame, units: tuple[float, ...] = (1e3, 1e4, 1e8), tolerance: float = 0.03) -> DataFrame:
    """The least factor by which the sums of all of a report's dimensions meet the anchor; reports that none mends give no row."""
    units = tuple(sorted(units))
    s = breakdown.groupBy("code", "year", "dim").agg(F.sum("amount").alias("s")).where("s <> 0").join(anchors.select("code", "year", F.col("revenue").cast("double").alias("a")), ["code", "year"]).where("a is not null")
    fits = s.groupBy("code", "year").agg(*(F.bool_and(F.abs(F.col("s").cast("double") * u - F.col("a")) <= tolerance * F.col("a")).alias(f"u{i}") for i, u in enumerate(units)))
    first = F.coalesce(*(F.when(F.col(f"u{i}"), F.lit(u)) for i, u in enumerate(units)))
    return fits.select("code", "year", first.alias("unit")).where("unit is not null")
