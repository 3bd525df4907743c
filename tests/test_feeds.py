"""Feeds whose files differ in columns: every row is priced by the columns of its own file."""

import pytest
from pyspark.sql import functions as F

import riskprice as rp
from riskprice.sources import feeds, files


def mixed(portfolio, folder, fmt):
    """Three kinds of files; returns the frames that were written."""
    ids = [F.col("borrower_id").alias("borrower_id")]
    kinds = [portfolio,
             portfolio.withColumn("borrower_id", F.concat(F.lit("R"), *ids)).withColumn("interest_rate", F.lit(0.11)),
             portfolio.withColumn("borrower_id", F.concat(F.lit("U"), *ids)).drop("undrawn_amount", "loan_to_value")
                      .withColumn("note", F.lit("x"))]
    for k in kinds:
        files.write(k.repartition(2), folder, fmt, mode="append")
    return kinds


def rows(df, columns):
    return sorted((tuple(None if c not in df.columns else r[c] for c in columns) for r in df.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("fmt", files.FORMATS)
def test_each_file_is_priced_by_its_own_columns(spark, portfolio, tmp_path, fmt):
    folder = str(tmp_path / "feed")
    kinds = mixed(portfolio, folder, fmt)
    read = feeds.facility_feeds(spark, folder, fmt)
    assert len(read) == 3
    priced = feeds.price_feeds(read)
    assert priced.count() == 3 * portfolio.count()
    columns = ["borrower_id", "pd_score", "lgd_score", "ead_amount", "interest_revenue", "net_income", "raroc", "risk_rating"]
    want = sorted((r for k in kinds for r in rows(rp.price_facilities(k.drop("note")), columns)), key=lambda r: r[0])
    assert rows(priced, columns) == want


def test_files_that_differ_only_in_unknown_columns_are_one_feed(spark, portfolio, tmp_path):
    folder = str(tmp_path / "feed")
    files.write(portfolio, folder)
    files.write(portfolio.withColumn("note", F.lit(1)), folder, mode="append")
    assert len(feeds.facility_feeds(spark, folder)) == 1


def test_one_folder_read_names_the_columns_that_differ(spark, portfolio, tmp_path):
    folder = str(tmp_path / "feed")
    mixed(portfolio, folder, "parquet")
    with pytest.raises(ValueError, match="interest_rate"):
        files.read_facilities(spark, folder)


def test_a_file_without_a_required_column_is_named(spark, portfolio, tmp_path):
    folder = str(tmp_path / "feed")
    files.write(portfolio, folder)
    files.write(portfolio.drop("industry"), folder, mode="append")
    with pytest.raises(ValueError, match="part-.*industry"):
        feeds.facility_feeds(spark, folder)


def test_partitioned_folders_keep_their_files_apart(spark, portfolio, tmp_path):
    folder = str(tmp_path / "feed")
    files.write(portfolio, folder + "/day=1")
    files.write(portfolio.withColumn("fee_rate", F.lit(0.02)), folder + "/day=2")
    read = feeds.facility_feeds(spark, folder)
    assert sorted("fee_rate" in f.columns for f in read) == [False, True]
    assert sum(f.count() for f in read) == 2 * portfolio.count()
