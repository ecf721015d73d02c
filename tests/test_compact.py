"""Derived tables and pay rules keep their rows in forms whose generated methods the JVM compiles."""

import re

from pyspark.sql import functions as F

from workloom.functions import pay, rules
from workloom.sources import catalog

#: Bytes of a method from which on the JVM interprets it.
LONGEST_METHOD = 8000


def _longest_method(spark, df):
    code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(
        df._jdf.queryExecution().executedPlan())
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code))


def test_places_in_arrays_are_those_of_the_case(spark):
    values = ["a", None, "c"]
    case = catalog.pick("k", values)
    place = catalog.with_arrays(case)
    assert "CASE" not in place
    rows = spark.createDataFrame([(k,) for k in (None, -4, -1, 0, 1, 2, 3, 5, 10**12)], "k BIGINT")
    found = rows.select("k", F.expr(case).alias("a"), F.expr(place).alias("b")).collect()
    assert all(r.a == r.b for r in found)
    assert {r.k: r.b for r in found}[5] == "c" and {r.k: r.b for r in found}[-1] is None


def test_derived_rows_and_prices_come_from_short_methods(spark, tmp_path):
    spark.sql("SELECT id AS o_orderkey, id % 7 AS o_custkey, 1000.5D + id AS o_totalprice, TIMESTAMP '2026-01-01' AS o_orderdate FROM range(200)").write.parquet(
        str(tmp_path / "orders.parquet"))
    tables = catalog.Tables(spark, str(tmp_path))
    tables._made["orders"] = spark.read.parquet(str(tmp_path / "orders.parquet"))  # as of many files: no shuffle before
    assert _longest_method(spark, tables.postings) < LONGEST_METHOD
    raw = spark.createDataFrame([("₹3-5 Lacs",), ("Competitive salary",), (None,), ("",), ("$45K",)], "salary_text STRING").repartition(2)
    raw.write.parquet(str(tmp_path / "raw"))
    priced = pay.with_salary_columns(spark.read.parquet(str(tmp_path / "raw")))
    assert _longest_method(spark, priced) < LONGEST_METHOD
    found = {r.salary_text: (r.salary_text_min, r.salary_text_max) for r in priced.collect()}
    assert found["₹3-5 Lacs"] == (300000.0, 500000.0)
    assert found["Competitive salary"] == found[None] == found[""] == (None, None)


def test_a_loop_over_words_finds_what_the_tests_find(spark):
    rows = spark.createDataFrame([("not disclosed",), ("x",), ("",), (None,), ("it's tbd",)], "x STRING")
    words = ["disclosed", "it's", "q"]
    found = rows.select(F.expr(rules.contains_any("x", words)).alias("a"), F.expr(rules.holds_any("x", words)).alias("b")).collect()
    assert [r.a for r in found] == [r.b for r in found] == [True, False, False, None, True]
