"""Models of the user's own: priced, listed, and joined to the grid."""

import pytest
from pyspark.sql import functions as F

import riskprice as rp
from riskprice.sources import catalog, files


def watchlist(columns, params):
    return F.when(F.col("industry") == "energy", F.lit(0.2)).otherwise(F.lit(0.02)) * F.lit(params.stress_pd_factor)


def flat_lgd(columns, params):
    return F.lit(0.4) if "seniority" not in columns else F.when(F.col("seniority") == "subordinated", 0.7).otherwise(0.4)


@pytest.fixture
def own():
    with rp.own_models():
        rp.register_pd_model("watchlist", watchlist, requires=["industry"], description="two rates")
        rp.register_lgd_model("flat", flat_lgd, description="by rank")
        yield


def test_own_models_are_priced(spark, portfolio, own):
    got = {r.borrower_id: r for r in rp.price_facilities(portfolio, "watchlist", "flat").collect()}
    for r in portfolio.collect():
        p = 2.0 * (0.2 if r.industry == "energy" else 0.02)
        loss = 0.7 if r.seniority == "subordinated" else 0.4
        priced = got[r.borrower_id]
        assert (priced.pd_score, priced.lgd_score) == (p, loss)
        assert priced.expected_loss == pytest.approx(p * loss * priced.ead_amount)
    mixed = rp.price_facilities(portfolio, "watchlist", "hybrid").first()
    assert mixed.pd_score in (0.4, 0.04) and 0.05 <= mixed.lgd_score <= 0.95


def test_own_models_join_the_grid(spark, portfolio, own):
    grid = {(r.pd_model, r.lgd_model): r.asDict() for r in rp.model_grid(portfolio).collect()}
    assert len(grid) == 4 * 4 and set(grid) == set(rp.model_pairs())
    for pair, got in grid.items():
        want = rp.portfolio_summary(rp.price_facilities(portfolio, *pair)).first().asDict()
        assert {k: got[k] for k in want} == want, pair
    assert rp.model_grid_rows(portfolio).count() == 16 * portfolio.count()
    names = {r.name for r in catalog.model_catalog(spark).collect()}
    assert {"watchlist", "flat", "logistic"} <= names


def test_what_is_registered_can_go(spark, portfolio):
    with rp.own_models():
        rp.register_pd_model("mine", watchlist)
        rp.unregister_pd_model("mine")
        rp.register_lgd_model("flat", flat_lgd)
    for models in (("mine", "hybrid"), ("logistic", "flat")):
        with pytest.raises(ValueError, match="Unknown"):
            rp.price_facilities(portfolio, *models)
    assert len(rp.model_pairs()) == 9


def test_errors_name_the_model(portfolio, own):
    with pytest.raises(ValueError, match="watchlist.*industry"):
        rp.price_facilities(portfolio.drop("industry"), "watchlist")
    for name in ("logistic", "watchlist"):
        with pytest.raises(ValueError, match="already"):
            rp.register_pd_model(name, watchlist)
    rp.register_pd_model("watchlist", lambda c, p: F.lit(1), replace=True)
    for name in ("", "Big", "a b", "1st"):
        with pytest.raises(ValueError, match="name"):
            rp.register_pd_model(name, watchlist)
    rp.register_pd_model("number", lambda c, p: 0.5)
    with pytest.raises(TypeError, match="number"):
        rp.price_facilities(portfolio, "number")
    with pytest.raises(ValueError, match="same key"):
        rp.register_lgd_model("based_hybrid", flat_lgd)
        rp.register_pd_model("score", watchlist)


def test_cli_imports_models(spark, portfolio, tmp_path, monkeypatch):
    from riskprice import cli
    (tmp_path / "house_models.py").write_text("import riskprice as rp\nfrom pyspark.sql import functions as F\n"
                                              "rp.register_pd_model('house', lambda c, p: F.lit(0.03), replace=True)\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    files.write(portfolio, feed)
    with rp.own_models():
        got = cli.run(["publish-facilities", "--input", feed, "--output", out, "--models", "house_models", "--pd-model", "house"], spark)
    assert got["summary"]["average_pd"] == pytest.approx(0.03) and rp.read_published(spark, out).count() == 8
    with pytest.raises(ValueError, match="Unknown PD model"):
        cli.run(["publish-facilities", "--input", feed, "--output", out, "--pd-model", "nobody"], spark)


def test_cli_streams_and_products(spark, portfolio, products, tmp_path):
    from riskprice import cli
    from riskprice.streaming import latest_report, read_batches
    feed = str(tmp_path / "feed")
    files.write(portfolio, feed + "/f")
    files.write(products, feed + "/p")
    for job in ("stream-checked", "stream-report"):
        cli.run([job, "--input", feed + "/f", "--output", f"{tmp_path}/{job}", "--checkpoint", f"{tmp_path}/ck-{job}",
                 "--available-now", "--columns", *portfolio.columns], spark)
    assert read_batches(spark, f"{tmp_path}/stream-checked").count() == 8
    assert latest_report(spark, f"{tmp_path}/stream-report").first().facility_count == 8
    got = cli.run(["publish-products", "--input", feed + "/p", "--output", str(tmp_path / "pp")], spark)
    assert got["summary"]["total_products"] == 5
