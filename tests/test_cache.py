"""The table cache: filters on file names, writes that are whole or not at all, misses that fill themselves; profiles to apply."""

import os

import pytest
from pyspark.sql import functions as F

from tablewright.operators import profiles
from tablewright.sources import table_cache

TABLES = "code string, year int, table_id int, page int, section string, caption string, table array<array<string>>"


def tables(spark, *keys):
    return spark.createDataFrame([(c, y, 1, 20, "gov", "", [["a", None], [f"{c}{y}"]]) for c, y in keys], TABLES)


def files(path):
    return sorted(f for _, _, names in os.walk(path) for f in names)


def test_filters_reach_the_file_names(spark, tmp_path):
    table_cache.put(tables(spark, ("1", 2020), ("1", 2021), ("2", 2020)), f"file://{tmp_path}/c")
    assert files(tmp_path / "c") == ["1_2020.json", "1_2021.json", "2_2020.json"]
    (tmp_path / "c" / "2_2020.json").write_text("not read")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("table_cache").load(str(tmp_path / "c"))
    assert [tuple(r) for r in df.where("code = '1' and year in (2021, 2022)").select("code", "year", "grid").collect()] == [("1", 2021, [["a", None], ["12021"]])]
    r = table_cache._Reader({"path": str(tmp_path / "c"), "files": "2"})
    assert [len(p.paths) for p in r.partitions()] == [2, 1]
    assert list(r.pushFilters([table_cache.EqualTo(("code",), "1"), table_cache.EqualTo(("page",), 3)])) == [table_cache.EqualTo(("page",), 3)]
    assert [p.paths for p in r.partitions()] == [[f"{tmp_path}/c/1_2020.json", f"{tmp_path}/c/1_2021.json"]]
    assert df.where("code = '9'").count() == 0


def test_a_failed_write_leaves_the_cache_as_it_was(spark, tmp_path):
    folder = str(tmp_path / "c")
    table_cache.put(tables(spark, ("1", 2020)), folder)
    before = (tmp_path / "c" / "1_2020.json").read_text()
    bad = F.udf(lambda c: 1 // 0 if c == "7" else c)
    more = tables(spark, ("1", 2020), ("3", 2020), ("7", 2020)).withColumn("caption", F.lit("new")).withColumn("section", bad("code"))
    with pytest.raises(Exception, match="ZeroDivision"):
        table_cache.put(more, folder)
    assert files(folder) == ["1_2020.json"] and (tmp_path / "c" / "1_2020.json").read_text() == before
    table_cache.put(tables(spark, ("1", 2020)).withColumn("caption", F.lit("new")), folder)
    assert files(folder) == ["1_2020.json"] and "new" in (tmp_path / "c" / "1_2020.json").read_text()


def test_misses_are_scanned_once_and_kept(spark, tmp_path):
    folder = str(tmp_path / "c")
    table_cache.put(tables(spark, ("1", 2020)), folder)
    (tmp_path / "c" / "2_2020.json").write_text("[]")
    wanted = spark.createDataFrame([("1", 2020), ("2", 2020), ("3", 2020), ("3", 2020), ("4", 2020)], "code string, year int")
    asked = []

    def rescan(lost):
        asked.append(sorted(r.code for r in lost.collect()))
        return tables(spark, ("2", 2020), ("3", 2020))

    assert sorted(r.code for r in table_cache.get(wanted, folder, rescan).collect()) == ["1", "2", "3"]
    assert sorted(r.code for r in table_cache.get(wanted, folder, rescan).collect()) == ["1", "2", "3"]
    assert asked == [["2", "3", "4"], ["4"]]
    assert table_cache.get(wanted.limit(0), folder, rescan).count() == 0 and len(asked) == 2


def test_own_profiles_come_before_the_layouts(spark):
    reports = spark.createDataFrame([("a", 1, 7), ("b", 1, 7), ("c", 1, None)], "code string, year int, print int")
    own = spark.createDataFrame([("a", 1, 10, "rev", "p2", False), ("a", 1, 10, None, "p1", None), ("a", 1, 11, "rev", "p", True), ("a", 1, 12, "cost", "p", False), ("z", 1, 10, "rev", "p", False)], "code string, year int, page int, field string, profile string, synced boolean")
    shared = spark.createDataFrame([("rev", 7, 10, "s"), ("rev", 7, 11, "s"), ("cost", 7, 13, "s"), ("rev", 8, 10, "s")], "field string, print int, page int, profile string")
    log = spark.createDataFrame([("b", 1, "rev", 10), ("b", 1, "cost", 11)], "code string, year int, field string, page int")
    todo = profiles.pending(reports, own, shared, log, "rev")
    assert sorted(map(tuple, todo.collect())) == [("a", 1, 10, "p1", "report"), ("a", 1, 11, "s", "fingerprint"), ("b", 1, 11, "s", "fingerprint")]
    old = spark.createDataFrame([("a", 1, 10, 1), ("a", 1, 11, 2), ("b", 1, 11, 3)], "code string, year int, page int, table_id int")
    new = spark.createDataFrame([("a", 1, 10, 91, "p1"), ("a", 1, 10, 92, "p1"), ("a", 1, 11, 93, "other")], "code string, year int, page int, table_id int, profile string")
    patched, logged = profiles.applied(old, new, todo, "rev")
    assert sorted(r.table_id for r in patched.collect()) == [2, 3, 91, 92]
    assert [tuple(r) for r in logged.collect()] == [("a", 1, "rev", 10, "p1", "report")]
