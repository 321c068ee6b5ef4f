"""Extraction profiles that helped once: kept for a report's page, or for a page of all reports of a layout, and what is still to be applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT = ["code", "year"]


def pending(reports: DataFrame, own: DataFrame, shared: DataFrame, log: DataFrame, field: str) -> DataFrame:
    """code, year, page, profile, source of each page that a profile has still to be applied to. ``own`` (code, year, page, field, profile, synced) are
    a report's profiles, of which those of another field, and those in sync, don't count; ``shared`` (field, print, page, profile)
    those of a layout, for reports (code, year, print) whose own don't name the page and that the ``log`` (code, year, field, page) lacks. Null fields
    hold for all, null prints for none; of several profiles for a page the first by name counts."""
    live = own.where(~F.coalesce("synced", F.lit(False)) & F.coalesce(F.col("field") == field, F.lit(True)))
    mine = live.groupBy(*REPORT, "page").agg(F.min("profile").alias("profile")).join(reports.select(*REPORT), REPORT, "left_semi")
    theirs = shared.where(F.col("field") == field).groupBy("print", "page").agg(F.min("profile").alias("profile"))
    theirs = reports.select(*REPORT, "print").join(theirs, "print").drop("print")
    theirs = theirs.join(mine.select(*REPORT, "page"), [*REPORT, "page"], "left_anti").join(log.where(F.col("field") == field).select(*REPORT, "page"), [*REPORT, "page"], "left_anti")
    tag = lambda df, source: df.select(*REPORT, "page", "profile", F.lit(source).alias("source"))
    return tag(mine, "report").unionByName(tag(theirs, "fingerprint"))


def applied(tables: DataFrame, rescans: DataFrame, todo: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """(tables, log): the pages of ``todo`` that their profile gave tables for (``rescans`` with a column profile besides those of ``tables``) replaced by
    those, and a log row for each such page. Pages without new tables stay as they are and aren't logged."""
    new = rescans.join(todo.select(*REPORT, "page", "profile"), [*REPORT, "page", "profile"], "left_semi").select(*tables.columns)
    pages = new.select(*REPORT, "page").distinct()
    patched = tables.join(pages, [*REPORT, "page"], "left_anti").unionByName(new)
    return patched, todo.join(pages, [*REPORT, "page"], "left_semi").select(*REPORT, F.lit(field).alias("field"), "page", "profile", "source")
