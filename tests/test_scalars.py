"""Coercion, merging and timestamps."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratalog.functions import scalars as sc


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize(
    "text, want", [("12", 12.0), ("-3.5", -3.5), ("1e5", None), ("1.5e2", 150.0), ("abc", None), ("", None), (" 7 ", 7.0), (".", None)]
)
def test_number(spark, text, want):
    assert value(spark, sc.coerce_number(F.lit(text), "string")) == want


def test_number_of_other_types(spark):
    assert value(spark, sc.coerce_number(F.lit(3), "int")) == 3.0
    assert value(spark, sc.coerce_number(F.array(F.lit(1)), "array<int>")) is None


@pytest.mark.parametrize("text, want", [("TRUE", True), ("false", False), ("1", None), (None, None)])
def test_boolean(spark, text, want):
    assert value(spark, sc.coerce_boolean(F.lit(text).cast("string"), "string")) is want


def test_string(spark):
    assert value(spark, sc.coerce_string(F.lit(True), "boolean")) == "True"
    assert value(spark, sc.coerce_string(F.lit(5), "int")) == "5"


def test_warning_only_when_changed(spark):
    row = value(spark, sc.coerce_with_warning(F.lit("12"), "string", "number"))
    assert (row.value, row.warning) == ("12", "string '12' read as number 12")
    row = value(spark, sc.coerce_with_warning(F.lit("x"), "string", "number"))
    assert (row.value, row.warning) == ("x", None)
    row = value(spark, sc.coerce_with_warning(F.lit("x"), "string", "string"))
    assert row.warning is None
    row = value(spark, sc.coerce_with_warning(F.lit("TRUE"), "string", "boolean"))
    assert (row.value, row.warning) == ("True", "string 'TRUE' read as boolean True")


@pytest.mark.parametrize(
    "text",
    [
        "2024-03-01", "2024-03-01T10:20:30", "2024-03-01T10:20:30.123456", "2024-03-01T10:20:30Z",
        "2024-03-01T10:20:30+02:30", "2024-03-01 10:20:30-05:00", "2024-03-01T10:20", "2024-03-01T10:20:30+0230",
    ],
)
def test_iso_column_equals_literal(spark, text):
    want = sc.iso_to_utc(text)
    assert want is not None
    assert value(spark, sc.parse_iso_utc(F.lit(text))) == want


def test_iso_is_free_of_the_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = value(spark, sc.parse_iso_utc(F.lit("2024-07-01T00:30:00Z")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == dt.datetime(2024, 7, 1, 0, 30)


@pytest.mark.parametrize("text", ["yesterday", "2024-13-01", "2024-03-01T99:00:00", ""])
def test_bad_iso_is_null(spark, text):
    assert value(spark, sc.parse_iso_utc(F.lit(text))) is None
    assert sc.iso_to_utc(text) is None


def test_merge_maps(spark):
    a = F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2))
    b = F.create_map(F.lit("y"), F.lit(9), F.lit("z"), F.lit(3))
    assert value(spark, sc.merge_maps([a, b])) == {"x": 1, "y": 9, "z": 3}
