"""File sources/sinks with explicit schemas, JSON sink, one-pass job, catalogue."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

import riskprice as rp
from riskprice.operators import jobs
from riskprice.sources import catalog, files, tables
from riskprice.schemas import FACILITY_SCHEMA, PRODUCT_SCHEMA


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_facility_round_trip(spark, portfolio, fmt):
    d = tempfile.mkdtemp(prefix="rp-io-")
    files.write(portfolio, d, fmt)
    back = files.read_facilities(spark, d, fmt)
    assert back.schema == FACILITY_SCHEMA
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, portfolio.collect()))


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_product_round_trip(spark, products, fmt):
    d = tempfile.mkdtemp(prefix="rp-io-")
    files.write(products, d, fmt)
    back = files.read_products(spark, d, fmt)
    assert back.schema == PRODUCT_SCHEMA
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, products.collect()))


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_own_rates_are_read(spark, portfolio, fmt):
    d = tempfile.mkdtemp(prefix="rp-io-")
    feed = portfolio.withColumn("interest_rate", F.lit(0.1)).withColumn("fee_rate", F.lit(0.01))
    files.write(feed.withColumn("comment", F.lit("x")), d, fmt)
    back = files.read_facilities(spark, d, fmt)
    assert back.columns == FACILITY_SCHEMA.fieldNames() + ["interest_rate", "fee_rate"]
    priced = {r.borrower_id: r for r in rp.price_facilities(back).collect()}
    assert priced["B001"].interest_revenue == 500000.0 and priced["B001"].fee_revenue == 50000.0


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
@pytest.mark.parametrize("gone", [("undrawn_amount", "loan_to_value"), ("company_size", "region"), ("seniority",),
                                  ("loan_term",), ("employment_years", "debt_to_income")])
def test_absent_columns_give_the_dataframe_result(spark, portfolio, fmt, gone):
    d = tempfile.mkdtemp(prefix="rp-io-")
    feed = portfolio.drop(*gone)
    files.write(feed, d, fmt)
    back = files.read_facilities(spark, d, fmt)
    assert back.columns == feed.columns
    key = lambda r: r.borrower_id
    assert sorted(rp.price_facilities(back).collect(), key=key) == sorted(rp.price_facilities(feed).collect(), key=key)


def test_missing_required_column_and_bad_path(spark, portfolio):
    d = tempfile.mkdtemp(prefix="rp-io-")
    files.write(portfolio.drop("credit_score"), d)
    with pytest.raises(ValueError, match="credit_score"):
        files.read_facilities(spark, d)
    for fmt in files.FORMATS:
        with pytest.raises(Exception):
            files.read_facilities(spark, d + "/nowhere", fmt)


def test_checked_job_quarantines(spark, portfolio):
    """Accepted + rejected = input; mistyped, unreadable and negative rows are not priced."""
    d = tempfile.mkdtemp(prefix="rp-check-")
    rows = [json.loads(r) for r in portfolio.toJSON().collect()]
    rows += [{**rows[0], "borrower_id": "X1", "loan_to_value": "bad"}, {**rows[0], "borrower_id": "X2", "credit_score": "n/a"},
             {**rows[0], "borrower_id": "X3", "outstanding_amount": -100.0}]
    with open(d + "/feed.json", "w") as fh:
        fh.write("\n".join(map(json.dumps, rows)) + "\n{broken\n")
    m = jobs.price_checked(files.read_facilities(spark, d + "/feed.json", "json", keep_unreadable=True), d + "/out")
    assert (m["facility_count"], m["rejected_count"]) == (8, 4) and m["total_exposure"] == pytest.approx(30562500.0)
    assert spark.read.parquet(d + "/out/rows").count() == 8
    rejected = spark.read.parquet(d + "/out/rejected").collect()
    assert all(r.validation_errors for r in rejected)
    assert sum("unreadable" in r.validation_errors for r in rejected) == 3
    assert any("outstanding_amount_range" in r.validation_errors for r in rejected)


def test_json_sink_parses_back(portfolio):
    out = files.as_json(rp.price_facilities(portfolio), "borrower_id").collect()
    assert len(out) == 8
    doc = json.loads(out[0].json)
    assert doc["borrower_id"] == out[0].borrower_id and "stress_minimum_rate" in doc


def test_price_and_write_one_pass(spark, portfolio):
    d = tempfile.mkdtemp(prefix="rp-job-")
    m = jobs.price_and_write(portfolio, d + "/priced")
    s = rp.portfolio_summary(rp.price_facilities(portfolio)).first()
    assert m["facility_count"] == 8
    assert m["total_exposure"] == pytest.approx(s.total_exposure)
    assert m["portfolio_raroc"] == pytest.approx(s.portfolio_raroc)
    assert m["expected_loss_rate"] == pytest.approx(s.expected_loss_rate)
    dist = {(r.dimension, r.value): r["count"] for r in jobs.written_distributions(spark, d + "/priced").collect()}
    assert dist[("risk_rating", "AAA")] == 8
    assert dist[("pricing_recommendation", "HIGHLY_ATTRACTIVE")] == 8


def test_quality_split(spark):
    raw = tables.facilities(spark, "/root/testdata/sf0.001", spoiled=True)
    ok, bad = rp.split_facilities(raw)
    assert ok.count() + bad.count() == raw.count()
    assert ok.columns == raw.columns
    errs = {r.validation_errors for r in bad.collect()}
    assert errs <= {"credit_score_range", "debt_to_income_range",
                    "credit_score_range,debt_to_income_range"}


def test_quality_nulls_nan_and_missing(spark):
    from riskprice.operators import quality
    df = spark.createDataFrame(
        [("a", "n", "basic", float("nan"), 1), (None, "n", None, 1.0, 0), ("b", "n", "x", 2.0, 3)],
        PRODUCT_SCHEMA)
    ok, bad = rp.split_products(df)
    assert [r.product_id for r in ok.collect()] == ["b"]
    errs = sorted(r.validation_errors for r in bad.collect())
    assert errs == ["cost_range", "product_id_required,category_required,quantity_range"]
    miss = quality.with_errors(df.drop("name"), quality.PRODUCT_RULES).first()
    assert "name_missing" in miss.validation_errors


def test_model_catalog(spark):
    rows = catalog.model_catalog(spark).collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r.kind, []).append(r.name)
    assert kinds["pd_model"] == ["logistic", "score_based", "industry"]
    assert kinds["lgd_model"] == ["collateral", "industry", "hybrid"]
    assert kinds["risk_type"] == ["corporate", "sme", "retail", "sovereign", "bank"]
    assert kinds["economic_condition"] == ["recession", "normal", "expansion"]


def test_split_and_write_one_pass(spark):
    from riskprice.operators import quality
    raw = tables.facilities(spark, "/root/testdata/sf0.001", spoiled=True)
    d = tempfile.mkdtemp(prefix="rp-split-") + "/split"
    jobs.split_and_write(raw, quality.FACILITY_RULES, d)
    ok, bad = rp.split_facilities(raw)
    got_ok, got_bad = jobs.read_split(spark, d, True), jobs.read_split(spark, d, False)
    assert got_ok.count() == ok.count() and got_bad.count() == bad.count()
    assert got_ok.select(*ok.columns).exceptAll(ok).count() == 0
    assert got_bad.select(*bad.columns).exceptAll(bad).count() == 0


def test_cli_jobs(spark, portfolio, products):
    from riskprice import cli
    src = tempfile.mkdtemp(prefix="rp-cli-")
    files.write(portfolio, src + "/fac")
    files.write(products, src + "/prod")
    r = cli.run(["price-facilities", "--input", src + "/fac", "--output", src + "/priced",
                 "--pd-model", "score_based"], spark)
    assert r["summary"]["facility_count"] == 8 and r["summary"]["rejected_count"] == 0
    assert spark.read.parquet(src + "/priced/rows").count() == 8
    assert spark.read.parquet(src + "/priced/distributions").count() > 0
    assert spark.read.json(src + "/priced/summary").first().facility_count == 8
    cli.run(["model-grid", "--input", src + "/fac", "--output", src + "/grid"], spark)
    assert spark.read.parquet(src + "/grid").count() == 9
    r = cli.run(["price-products", "--input", src + "/prod", "--output", src + "/pp"], spark)
    assert r["summary"]["total_products"] == 5
    cli.run(["split-facilities", "--input", src + "/fac", "--output", src + "/split"], spark)
    assert jobs.read_split(spark, src + "/split", True).count() == 8


def test_csv_columns_go_by_name(spark, portfolio):
    d = tempfile.mkdtemp(prefix="rp-csv-") + "/feed"
    cols = portfolio.columns
    swapped = cols[:13] + [cols[14], cols[13]] + cols[15:]
    portfolio.select(*swapped).write.option("header", "true").csv(d)
    assert sorted(files.read_facilities(spark, d, "csv").collect()) == sorted(portfolio.collect())
    # a file with another header than the feed's first fails, it is never read by position
    portfolio.write.mode("append").option("header", "true").csv(d)
    with pytest.raises(Exception):
        files.read_facilities(spark, d, "csv").collect()


def test_json_type_drift_fails(spark):
    d = tempfile.mkdtemp(prefix="rp-json-")
    with open(d + "/a.json", "w") as fh:
        fh.write('{"product_id": "x", "name": "n", "category": "basic", "cost": "abc", "quantity": 1}\n')
    with pytest.raises(Exception):
        files.read_products(spark, d, "json").collect()


def test_cli_products_csv(spark, products):
    from riskprice import cli
    src = tempfile.mkdtemp(prefix="rp-cli-csv-")
    files.write(products, src + "/prod", "csv")
    r = cli.run(["price-products", "--format", "csv", "--input", src + "/prod", "--output", src + "/pp"], spark)
    assert r["summary"]["total_products"] == 5 and r["summary"]["total_quantity"] == 750


def test_cli_stream_totals(spark, portfolio):
    from riskprice import cli
    from riskprice.streaming import latest_totals
    src = tempfile.mkdtemp(prefix="rp-cli-st-")
    files.write(portfolio, src + "/fac")
    stream = ["stream-totals", "--input", src + "/fac", "--output", src + "/totals", "--checkpoint", src + "/ckpt", "--available-now"]
    with pytest.raises(ValueError, match="columns"):
        cli.run(stream, spark)
    cli.run(stream + ["--columns", *portfolio.columns], spark)
    t = latest_totals(spark, src + "/totals").first()
    assert t.facility_count == 8 and t.total_exposure == pytest.approx(30562500.0)
