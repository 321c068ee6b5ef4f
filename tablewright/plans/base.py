"""Bridge from the input tables to the disclosure model, and the decorator that registers queries.

A bridge view is one SELECT that Spark SQL and DuckDB read alike (the few functions that
differ are macros, see DIALECTS). In Spark the joined fact, its roll-ups and the grids are written
once for each session (STORED), so that no query joins the fact table again; the
oracle gets the same views as common table expressions, while the operator under test
is written once as a DataFrame operator and once, independently, as SQL.

Reports are (code, year) = (supplier, ship year). Class k = l_suppkey % 7 decides how the
parsed breakdown of a report departs from its true one:

0, 1 not at all | 2 largest segment lost | 3 regions doubled | 4 amounts / 10,000 (unit slip)
5 no anchor | 6 returned lines missing (only the main-business anchor can match)
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.session import cautious, dropped, shared_folder, written

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Macros: name -> (Spark, DuckDB); {0} is the argument, {1} and {2} what stands before and after its " / ".
DIALECTS = {
    "money": ("format_number({0}, 2)", "format('{{:,.2f}}', CAST({0} AS DOUBLE))"),
    "epoch": ("unix_micros({0})", "epoch_us({0})"),
    # a quotient to two places: DuckDB divides decimals as doubles, Spark as decimals of few places, which would be rounded twice
    "places2": ("round(CAST({1} AS DOUBLE) / CAST({2} AS DOUBLE) * 100, 0) / 100", "round({0}, 2)"),
}

VIEWS: dict[str, str] = {
    "fact": """
        SELECT lpad(CAST(l_suppkey AS STRING), 6, '0') AS code, CAST(year(l_shipdate) AS INT) AS year, CAST(l_suppkey % 7 AS INT) AS k,
               l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_tax, l_returnflag, l_linestatus, l_shipdate,
               CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS amt, CAST(l_extendedprice * l_tax AS DECIMAL(18,4)) AS tax,
               CAST(l_quantity * p_retailprice AS DECIMAL(18,4)) AS cst,
               c_custkey, c_name, c_mktsegment, p_type, p_brand, r_name, o_orderpriority
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey""",
    "brk": """
        SELECT code, year, k,
               CASE WHEN GROUPING(c_mktsegment) = 0 THEN 'industries' WHEN GROUPING(p_type) = 0 THEN 'segments' WHEN GROUPING(r_name) = 0 THEN 'regions' ELSE 'by_channel' END AS dim,
               coalesce(c_mktsegment, p_type, r_name, o_orderpriority) AS name,
               CAST(sum(amt) AS DECIMAL(20,4)) AS amount, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN amt END) AS DECIMAL(20,4)) AS kept
        FROM fact
        GROUP BY GROUPING SETS ((code, year, k, c_mktsegment), (code, year, k, p_type), (code, year, k, r_name), (code, year, k, o_orderpriority))""",
    "pred": """
        SELECT code, year, k, dim, name,
               CAST(round(CASE WHEN k = 3 AND dim = 'regions' THEN amount * 2 WHEN k = 4 THEN amount * CAST(0.0001 AS DECIMAL(5,4)) WHEN k = 6 THEN kept ELSE amount END, 2) AS DECIMAL(20,2)) AS amount
        FROM (SELECT *, row_number() OVER (PARTITION BY code, year, dim ORDER BY amount DESC, name) AS top FROM brk) b
        WHERE NOT (k = 2 AND dim = 'segments' AND top = 1) AND NOT (k = 6 AND kept IS NULL)""",
    "golden": "SELECT code, year, k, dim, name, CAST(round(amount, 2) AS DECIMAL(20,2)) AS amount FROM brk",
    "anchor": """
        SELECT code, year, CAST(round(sum(amt), 2) AS DECIMAL(20,2)) AS revenue, CAST(round(sum(cst), 2) AS DECIMAL(20,2)) AS cost,
               CAST(round(sum(tax), 2) AS DECIMAL(20,2)) AS rnd_expense, CAST(round(sum(CASE WHEN l_returnflag <> 'R' THEN amt END), 2) AS DECIMAL(20,2)) AS main_revenue
        FROM fact WHERE k <> 5 GROUP BY code, year""",
    "costs": """
        SELECT code, year, k, p_brand AS name, CAST(round(sum(CASE WHEN k = 2 AND l_linestatus = 'F' THEN CAST(0 AS DECIMAL(18,4)) ELSE cst END), 2) AS DECIMAL(20,2)) AS amount
        FROM fact GROUP BY code, year, k, p_brand""",
    "rnd": """
        SELECT code, year, k, l_returnflag AS name, CAST(round(CASE WHEN k = 3 THEN t * 2 WHEN k = 2 THEN t * CAST(0.97 AS DECIMAL(4,2)) ELSE t END, 2) AS DECIMAL(20,2)) AS amount
        FROM (SELECT code, year, k, l_returnflag, CAST(sum(tax) AS DECIMAL(20,4)) AS t FROM fact GROUP BY code, year, k, l_returnflag) f""",
    "rnd_total": "SELECT code, year, CAST(round(sum(tax), 2) AS DECIMAL(20,2)) AS total FROM fact GROUP BY code, year",
    "emp": """
        SELECT code, year, k, 'composition' AS dim, l_linestatus AS name, CAST(count(*) + CASE WHEN k = 3 AND l_linestatus = 'F' THEN 1 WHEN k = 4 AND l_linestatus = 'F' THEN 9 ELSE 0 END AS BIGINT) AS n
        FROM fact GROUP BY code, year, k, l_linestatus
        UNION ALL SELECT code, year, k, 'education', l_returnflag, CAST(count(*) AS BIGINT) FROM fact GROUP BY code, year, k, l_returnflag""",
    "emp_total": "SELECT code, year, CAST(count(*) AS BIGINT) AS total FROM fact GROUP BY code, year",
    "reports": "SELECT code, year, k, count(*) AS n_lines FROM fact GROUP BY code, year, k",
}


def _expand(sql: str, spark: bool) -> str:
    def one(m: re.Match) -> str:
        return DIALECTS[m[1]][0 if spark else 1].format(m[2], *m[2].split(" / "))

    return re.sub(r"@(\w+)\(([^()]*(?:\([^()]*\)[^()]*)*)\)", one, sql)


def _needed(sql: str, names: dict[str, str]) -> list[str]:
    """Views the text names, each after those that it needs itself."""
    out: list[str] = []
    for n in names:
        if re.search(rf"\b{n}\b", sql):
            out += [x for x in [*_needed(names[n], {k: v for k, v in names.items() if k != n}), n] if x not in out]
    return list(dict.fromkeys(out))


#: Views that are written once for a session and a data directory, and read by all that follow: the joined
#: fact and its roll-ups, which nearly every query needs, and the rendered grids.
STORED = ("fact", "brk", "anchor", "costs", "rnd", "rnd_total", "emp", "emp_total", "reports", "cells", "field_cells", "table_meta")
_paths: dict[tuple[str, str], dict[str, str]] = {}


def _select(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view's own SQL over the input tables and the stored views."""
    own = {k: v for k, v in VIEWS.items() if k != name}
    ctes, queue = {}, [VIEWS[name]]
    while queue:
        sql = queue.pop()
        for n in own:
            if n not in ctes and re.search(rf"\b{n}\b", sql):
                ctes[n] = f"SELECT * FROM parquet.`{_stored(spark, sf_dir, n)}`" if n in STORED else _expand(VIEWS[n], True)
                if n not in STORED:
                    queue.append(VIEWS[n])
    order = [n for n in _needed(VIEWS[name], own) if n in ctes]
    body = ",\n".join(f"{n} AS ({ctes[n]})" for n in order) + ",\n" * bool(order) + f"{name} AS ({_expand(VIEWS[name], True)})"
    tables = [t for t in TABLES if re.search(rf"\b{t}\b", re.sub(r"`[^`]*`", "", body))]
    head = "".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`),\n" for t in tables)
    return spark.sql(f"WITH {head}{body}\nSELECT * FROM {name}")


def _stored(spark: SparkSession, sf_dir: str, name: str) -> str:
    paths = _paths.setdefault((spark.sparkContext.applicationId, sf_dir), {})
    if name not in paths:
        path = f"{shared_folder(spark)}/bridge-{uuid.uuid4().hex}-{name}"
        written(_select(spark, sf_dir, name), path)
        paths[name] = path
    return paths[name]


def forget(spark: SparkSession, sf_dir: str) -> None:
    """Delete the stored views of a data directory, as after a change of its tables."""
    for path in _paths.pop((spark.sparkContext.applicationId, sf_dir), {}).values():
        dropped(spark, path)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table or a bridge view: a stored one from its files, any other as one lazy plan."""
    cautious(spark)
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in STORED:
        return spark.read.parquet(_stored(spark, sf_dir, name))
    return _select(spark, sf_dir, name)


def oracle(sql: str) -> str:
    """The SQL with the views that it names put before it."""
    ctes = _needed(sql, VIEWS)
    body = ",\n".join(f"{n} AS ({_expand(VIEWS[n], False)})" for n in ctes)
    sql = _expand(sql.strip(), False)
    if not ctes:
        return sql
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {body},\n{sql[15:]}"
    return f"WITH {body},\n{sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH {body}\n{sql}"


def query(name: str, sql: str | None = None):
    """Register f(load) -> DataFrame, where load(view name) gives the view; ``sql`` is its oracle."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda n: view(spark, sf_dir, n))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return put
