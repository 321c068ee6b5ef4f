"""Rule versions: aliases and markers as rows, merged, overridden and changed by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_VERSIONS = 10_000


def merged(pool: DataFrame, base: int = 0) -> DataFrame:
    """Of each version in a pool (version, role, alias, pos): the base's aliases in their order, then those that the version adds; an
    alias keeps its first place. The base's rows, a rule's aliases, are repeated for each version: more than MOST_VERSIONS are refused."""
    versions = pool.select("version").distinct()
    if versions.count() > MOST_VERSIONS:
        raise ValueError(f"more than {MOST_VERSIONS} versions")
    own = pool.where(F.col("version") != base).select("version", "role", "alias", F.struct(F.lit(True).alias("added"), "pos").alias("at"))
    shared = F.broadcast(versions).crossJoin(pool.where(F.col("version") == base).select("role", "alias", F.struct(F.lit(False).alias("added"), "pos").alias("at")))
    first = own.unionByName(shared).groupBy("version", "role", "alias").agg(F.min("at").alias("at"))
    return first.select("version", "role", "alias", F.row_number().over(Window.partitionBy("version", "role").orderBy("at", "alias")).alias("place"))


def at_version(pool: DataFrame, version: int, base: int = 0) -> DataFrame:
    """The rule of one version, for a caller that tries it in place of the current one."""
    return merged(pool.where(F.col("version").isin(base, version)), base).where(F.col("version") == version).drop("version")


def sanitized(requests: DataFrame, rule: DataFrame, least: int = 2, most: int = 12) -> DataFrame:
    """Requests (id, role, alias) that may change the rule: of a role that it has, of a fair length, and new."""
    r = requests.withColumn("alias", F.trim("alias")).where(F.length("alias").between(least, most))
    r = r.join(rule.select("role").distinct(), "role", "left_semi")
    return r.join(rule.select("role", "alias"), ["role", "alias"], "left_anti").select("id", "role", "alias")


def add_markers(requests: DataFrame, known: dict[str, str]) -> DataFrame:
    """What becomes of requests (id, marker, dim) for section markers: invalid (too short, or no dimension), noop (known with it),
    conflict (known with another) or added."""
    m, dims = F.trim("marker"), sorted(set(known.values()))
    has = F.try_element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), m)
    return requests.select("id", F.when((F.length(m) < 2) | ~F.col("dim").isin(*dims), "invalid").when(has == F.col("dim"), "noop").when(has.isNotNull(), "conflict").otherwise("added").alias("outcome"))
