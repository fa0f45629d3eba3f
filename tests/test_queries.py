"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratalog.plans import ORACLES, QUERIES
from tests.oracle import TABLES, compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "customer", "status", "total", "total_count"]
    assert len(df.collect()) == 20


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    _, problem = compare(spark, FOLDER, name, QUERIES[name], ORACLES[name], duck)
    assert problem is None, problem


@pytest.mark.parametrize("name", ["put", "update", "apply_release_diff"])
def test_parts_whose_keys_lie_a_million_apart(spark, folder, name):
    for table in TABLES:
        os.symlink(f"{FOLDER}/{table}.parquet", f"{folder}/{table}.parquet") if table != "part" else None
    part = spark.read.parquet(f"{FOLDER}/part.parquet")
    both = part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 1_000_000))
    both.coalesce(1).write.parquet(f"{folder}/parts")
    (file,) = [f for f in os.listdir(f"{folder}/parts") if f.endswith(".parquet")]
    os.symlink(f"{folder}/parts/{file}", f"{folder}/part.parquet")
    _, problem = compare(spark, folder, name, QUERIES[name], ORACLES[name], connect(folder))
    assert problem is None, problem
