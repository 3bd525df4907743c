"""Feeds from tables that are stored by their join key: no exchange under the join."""

import re

import pytest
from pyspark.sql import functions as F

import riskprice as rp
from riskprice.sources import bucketed, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def under_the_feed_join(plan, key):
    """The plan's lines below the sort-merge join on ``key``."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line and key in line)
    depth = lambda line: len(re.match(r"[\s:|+\-*]*", line).group())
    below = []
    for line in lines[at + 1:]:
        if depth(line) <= depth(lines[at]):
            break
        below.append(line)
    return "\n".join(below)


def test_facilities_without_a_shuffle(spark, tmp_path, no_broadcast):
    folder = str(tmp_path / "pair")
    bucketed.write_facility_tables(spark, SF, folder, buckets=4, salts=3)
    got, want = bucketed.facilities(spark, SF, folder), tables.facilities(spark, SF)
    below = under_the_feed_join(plan_of(got), "o_custkey")
    assert "Exchange" not in below and "SelectedBucketsCount" in below
    assert "Exchange" in under_the_feed_join(plan_of(want), "o_custkey")
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert rp.model_grid(got).exceptAll(rp.model_grid(want)).count() == 0


def test_product_lines_without_a_shuffle(spark, tmp_path, no_broadcast):
    folder = str(tmp_path / "pair")
    bucketed.write_product_tables(spark, SF, folder, buckets=5)
    got, want = bucketed.product_lines(spark, SF, folder), tables.product_lines(spark, SF)
    assert "Exchange" not in under_the_feed_join(plan_of(got), "l_partkey")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_a_session_without_the_tables_attaches_them(spark, tmp_path, no_broadcast):
    folder = str(tmp_path / "pair")
    bucketed.write_facility_tables(spark, SF, folder, buckets=4)
    for side in ("fact", "dimension"):
        spark.sql(f"DROP TABLE {bucketed._name(f'{folder}/{side}')}")       # files stay: the table is external
    got = bucketed.facilities(spark, SF, folder)
    assert "Exchange" not in under_the_feed_join(plan_of(got), "o_custkey")
    assert got.count() == tables.facilities(spark, SF).count()
    with pytest.raises(ValueError, match="no buckets"):
        bucketed.join_pair(spark, str(tmp_path / "none"))


def test_a_hot_key_is_spread(spark, tmp_path, no_broadcast):
    """One customer has half of all rows; no task of the join gets more than its share."""
    fact = spark.range(8000).select(F.col("id").alias("row"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 500)
                                    .cast("int").alias("k"))
    dimension = spark.range(500).select(F.col("id").cast("int").alias("d"), F.col("id").alias("name"))
    largest = {}
    for salts in (1, 16):
        folder = str(tmp_path / f"pair{salts}")
        bucketed.write_pair(fact, dimension, folder, "k", "d", ["row"], buckets=16, salts=salts)
        joined = bucketed.join_pair(spark, folder)
        assert joined.count() == 8000 and joined.where("name <> k").count() == 0
        largest[salts] = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest[1] > 4000 and largest[16] < 2000


def test_null_keys_and_types(spark, tmp_path):
    fact = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "row int, k int")
    dimension = spark.createDataFrame([(1, "a"), (None, "b")], "d int, name string")
    bucketed.write_pair(fact, dimension, str(tmp_path / "p"), "k", "d", ["row"], buckets=2)
    assert [tuple(r) for r in bucketed.join_pair(spark, str(tmp_path / "p")).collect()] == [(1, 1, 1, "a")]
    with pytest.raises(ValueError, match="types"):
        bucketed.write_pair(fact, dimension.withColumn("d", F.col("d").cast("long")), str(tmp_path / "q"), "k", "d", ["row"], 2)
