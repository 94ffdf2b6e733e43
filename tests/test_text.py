"""Texts of numbers."""

from pyspark.sql import functions as F

from triagelake.functions.text import fixed


def test_decimals_are_rounded_as_by_printf(spark):
    x = sorted({a / b for b in range(1, 41) for a in range(0, 161)} | {0.05, 0.125, 0.375, 7.125, 7.995, 7.985, 9.95, 99.995, 12345.25})
    rows = spark.createDataFrame([(v,) for v in [*x, None]], "x double").select("x", fixed(F.col("x"), 1).alias("one"), fixed(F.col("x"), 2).alias("two")).collect()
    assert [(r["one"], r["two"]) for r in rows if r["x"] is not None] == [("%.1f" % r["x"], "%.2f" % r["x"]) for r in rows if r["x"] is not None]
    assert [(r["one"], r["two"]) for r in rows if r["x"] is None] == [(None, None)]
    assert {r["x"]: r["one"] for r in rows}[1.25] == "1.2"
