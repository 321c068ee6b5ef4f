"""Judgements from outside (people or models) enter as tables; nothing here calls out.

A verdict source gives (code, year, field, verdict, suspects) for the records it is asked about. The stub judges by rule, so
that routes and cascades can be run and tested without one.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class VerdictSource(Protocol):
    def judge(self, records: DataFrame) -> DataFrame:
        """code, year, field, verdict ('pass', 'hold', 'error') and suspects, at most a row for each record."""


class TableVerdicts:
    """Verdicts gathered elsewhere, read from a table."""

    def __init__(self, verdicts: DataFrame) -> None:
        self.verdicts = verdicts

    def judge(self, records: DataFrame) -> DataFrame:
        return self.verdicts.join(records.select("code", "year", "field").distinct(), ["code", "year", "field"], "left_semi")


class RuleVerdicts:
    """Passes what has high confidence, holds the rest."""

    def judge(self, records: DataFrame) -> DataFrame:
        good = F.col("confidence") == "high"
        return records.select("code", "year", "field", F.when(good, "pass").otherwise("hold").alias("verdict"), F.when(good, F.array().cast("array<string>")).otherwise(F.array(F.lit("amount_error"))).alias("suspects"))
