"""One-pass jobs: everything of a run appears at once, and the feed is scanned once."""

import pytest
from pyspark.sql import functions as F

import riskprice as rp
from riskprice.operators import publish
from riskprice.params import ProductRules
from riskprice.sources import feeds, files, tables

SF = "/root/testdata/sf0.001"


def test_rows_totals_distributions_and_failures(spark, tmp_path):
    raw, out = tables.facilities(spark, SF, spoiled=True), str(tmp_path / "out")
    got = publish.publish_facilities(raw, out)
    ok, bad = rp.split_facilities(raw)
    priced = rp.price_facilities(ok)
    assert got["summary"] == rp.portfolio_summary(priced).first().asDict()
    assert (got["summary"]["facility_count"], got["rejected_count"]) == (ok.count(), bad.count())
    for name, counts in (("risk_rating", rp.risk_distribution(priced)), ("pricing_recommendation", rp.recommendation_distribution(priced))):
        assert got[name] == {r[name]: r["count"] for r in counts.collect()}
    names = bad.select(F.explode(F.split("validation_errors", ",")).alias("n")).groupBy("n").count()
    assert got["failures"] == {r["n"]: r["count"] for r in names.collect()}
    rows, rejected = publish.read_published(spark, out), publish.read_published(spark, out, accepted=False)
    assert sorted(rows.columns) == sorted(priced.columns)
    assert rows.select(*priced.columns).exceptAll(priced).count() == 0 and rows.count() == priced.count()
    assert rejected.select(*bad.columns).exceptAll(bad).count() == 0 and rejected.count() == bad.count()
    assert rejected.where("raroc IS NOT NULL OR pd_score IS NOT NULL").count() == 0


def test_products(spark, tmp_path):
    raw, out = tables.product_lines(spark, SF, spoiled=True), str(tmp_path / "out")
    rules = ProductRules(bulk_threshold=40, medium_threshold=20)
    got = publish.publish_products(raw, out, rules)
    ok, bad = rp.split_products(raw)
    assert got["summary"] == rp.product_summary(rp.price_products(ok, rules)).first().asDict()
    assert got["rejected_count"] == bad.count()
    assert publish.read_published(spark, out, accepted=False).count() == bad.count()


def test_a_killed_run_leaves_the_old_result(spark, portfolio, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    publish.publish_facilities(portfolio, out)
    reader = publish.read_published(spark, out)
    boom = F.when(F.col("borrower_id") == "B003", F.raise_error(F.lit("lost"))).otherwise(F.col("exposure_amount"))
    with pytest.raises(Exception, match="lost"):
        publish.publish_facilities(portfolio.withColumn("exposure_amount", boom), out)
    assert publish.read_published(spark, out).count() == 8 and publish.manifest(spark, out)["summary"]["facility_count"] == 8

    def killed(*_):
        raise RuntimeError("killed before the manifest")
    monkeypatch.setattr(publish, "replace_text", killed)
    with pytest.raises(RuntimeError):
        publish.publish_facilities(portfolio.limit(2), out)
    monkeypatch.undo()
    assert publish.read_published(spark, out).count() == 8
    publish.publish_facilities(portfolio.limit(3), out)
    assert publish.read_published(spark, out).count() == 3 and reader.count() == 8      # the last run is kept for its readers
    publish.publish_facilities(portfolio.limit(4), out)
    m = publish.manifest(spark, out)
    assert len(m["history"]) == 1 and publish.read_published(spark, out).count() == 4


def test_empty_feed_and_nothing_published(spark, portfolio, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="nothing"):
        publish.read_published(spark, out)
    got = publish.publish_facilities(portfolio.limit(0), out)
    assert got["summary"]["facility_count"] == 0 and got["failures"] == {} and publish.read_published(spark, out).count() == 0


def test_the_feed_is_scanned_once(spark, portfolio, tmp_path):
    folder = str(tmp_path / "feed")
    files.write(portfolio.repartition(3), folder)
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: (seen.add(1), x)[1], "string").asNondeterministic()
    feed = files.read_facilities(spark, folder).withColumn("borrower_name", counted("borrower_name"))
    publish.publish_facilities(feed, str(tmp_path / "out"))
    assert seen.value == 8


def test_files_that_differ_in_columns(spark, portfolio, tmp_path):
    folder, out = str(tmp_path / "feed"), str(tmp_path / "out")
    other = portfolio.withColumn("borrower_id", F.concat(F.lit("R"), "borrower_id")).withColumn("interest_rate", F.lit(0.1))
    files.write(portfolio, folder)
    files.write(other, folder, mode="append")
    got = publish.publish_facilities(feeds.facility_feeds(spark, folder), out)
    want = rp.portfolio_summary(rp.price_facilities(portfolio).select("ead_amount", "expected_loss", "economic_capital", "net_income", "pd_score",
                                                                      "lgd_score", "raroc", "minimum_rate")
                                .unionByName(rp.price_facilities(other), allowMissingColumns=True)).first().asDict()
    assert got["summary"] == want and publish.read_published(spark, out).where("interest_rate IS NOT NULL").count() == 8
