"""Golden values of FIXTURES.md on the demonstration inputs."""

import pytest
from pyspark.sql import functions as F

import riskprice as rp
from riskprice.functions import pd as pdf
from riskprice.operators.model_grid import MODEL_PAIRS
from riskprice.schemas import FACILITY_SCHEMA
from helpers import by_id

approx = lambda x, rel=1e-9, abs=1e-9: pytest.approx(x, rel=rel, abs=abs)


def test_product_sample(products):
    rows = {r.product_id: r for r in rp.price_products(products).collect()}
    expect = {"P001": (200.0, 0.10, 180.0), "P002": (112.5, 0.05, 106.875),
              "P003": (60.0, 0.0, 60.0), "P004": (240.0, 0.10, 216.0), "P005": (36.0, 0.10, 32.4)}
    for pid, (b, d, f) in expect.items():
        assert rows[pid].base_price == approx(b)
        assert rows[pid].discount_rate == approx(d)
        assert rows[pid].final_price == approx(f)


def test_product_summary(products):
    s = rp.product_summary(rp.price_products(products)).first()
    assert s.total_revenue == approx(595.275)
    assert s.average_price == approx(119.055)
    assert (s.max_price, s.min_price) == (approx(216.0), approx(32.4))
    assert (s.total_quantity, s.total_products) == (750, 5)


def test_single_product_request(spark):
    df = spark.createDataFrame([("X", "Std", "standard", 100.0, 50)],
                               "product_id string, name string, category string, cost double, quantity int")
    r = rp.price_products(df).first()
    assert (r.base_price, r.final_price) == (150.0, 142.5)


MODEL_COLUMNS = {
    # id: z, score PD, industry PD, collateral LGD, industry LGD, hybrid LGD, EAD
    "B001": (-10.405, .005, .0120, .36000, .53550, .451710, 5000000),
    "B002": (-9.900, .042, .0315, .20000, .34200, .256800, 1875000),
    "B003": (-8.375, .1125, .0360, .78000, .45900, .716760, 3000000),
    "B004": (-10.230, .015, .0180, .32400, .42750, .383670, 1375000),
    "B005": (-10.225, .018, .0440, .20000, .26775, .249810, 10000000),
    "B006": (-7.510, .225, .0960, .95000, .54450, .827190, 500000),
    "B007": (-8.520, .035, .0180, .76500, .69300, .736200, 812500),
    "B008": (-10.600, .0525, .0585, .20000, .25650, .244860, 8000000),
}


def test_model_columns(portfolio):
    cols = portfolio.columns
    z = by_id(portfolio.select("borrower_id", pdf.logistic_score(cols, rp.LogisticModel()).alias("z")))
    sb = by_id(rp.add_pd(portfolio, "score_based"))
    ind = by_id(rp.add_pd(portfolio, "industry"))
    lc = by_id(rp.add_lgd(portfolio, "collateral"))
    li = by_id(rp.add_lgd(portfolio, "industry"))
    lh = by_id(rp.add_lgd(portfolio, "hybrid"))
    ead = by_id(rp.add_exposure(portfolio))
    for b, (zz, s, i, c, n, h, e) in MODEL_COLUMNS.items():
        assert z[b]["z"] == approx(zz)
        assert sb[b]["pd_score"] == approx(s)
        assert ind[b]["pd_score"] == approx(i)
        assert lc[b]["lgd_score"] == approx(c)
        assert li[b]["lgd_score"] == approx(n)
        assert lh[b]["lgd_score"] == approx(h)
        assert lh[b]["collateral_lgd"] == approx(c) and lh[b]["industry_lgd"] == approx(n)
        assert ead[b]["ead_amount"] == approx(e)


PRICING = {
    "B001": (600000, 2258.55, 147741.45, .246236, .048452, .049174),
    "B002": (225000, 481.5, 55768.5, .247860, .048257, .048668),
    "B003": (360000, 2150.28, 87849.72, .244027, .048717, .049864),
    "B004": (165000, 527.54625, 40722.45375, .246803, .048384, .048998),
    "B005": (1200000, 2498.1, 297501.9, .247918, .048250, .048650),
    "B006": (60000, 413.595, 14586.405, .243107, .048827, .050151),
    "B007": (97500, 598.1625, 23776.8375, .243865, .048736, .049914),
    "B008": (960000, 1958.88, 238041.12, .247959, .048245, .048637),
}


def test_logistic_hybrid_pricing(portfolio):
    priced = rp.price_facilities(portfolio)
    rows = by_id(priced)
    assert len(rows) == 8
    for b, (ec, el, ni, r, mr, smr) in PRICING.items():
        row = rows[b]
        assert row["pd_score"] == 0.001
        assert row["economic_capital"] == approx(ec)
        assert row["expected_loss"] == approx(el)
        assert row["net_income"] == approx(ni)
        assert row["raroc"] == approx(r, abs=5e-7)
        assert row["minimum_rate"] == approx(mr, abs=5e-7)
        assert row["stress_minimum_rate"] == approx(smr, abs=5e-7)
        assert row["risk_rating"] == "AAA"
        assert row["pricing_recommendation"] == "HIGHLY_ATTRACTIVE"


def test_output_columns(portfolio):
    tail = ["pd_score", "base_lgd", "ltv_adjustment", "seniority_adjustment", "lgd_score",
            "collateral_lgd", "industry_lgd", "ccf", "ead_amount", "regulatory_capital",
            "economic_capital", "expected_loss", "funding_cost", "operational_cost",
            "interest_revenue", "fee_revenue", "total_revenue", "net_income", "raroc",
            "risk_adjusted_margin", "required_revenue", "minimum_rate", "base_rate_component",
            "risk_premium_component", "operational_component", "capital_component",
            "risk_rating", "pricing_recommendation", "competitive_rate",
            "stress_expected_loss", "stress_minimum_rate"]
    inputs = [f.name for f in FACILITY_SCHEMA.fields]
    assert rp.price_facilities(portfolio).columns == inputs + tail
    coll = rp.price_facilities(portfolio, lgd_model="collateral").columns
    assert "collateral_lgd" not in coll and "base_lgd" in coll
    ind = rp.price_facilities(portfolio, lgd_model="industry").columns
    assert not {"base_lgd", "ltv_adjustment", "seniority_adjustment"} & set(ind)


GRID = {
    "logistic_collateral": (.247367, .048472, .0003160, .001000, .472375),
    "logistic_industry": (.247042, .048441, .0003550, .001000, .440719),
    "logistic_hybrid": (.247032, .048483, .0003562, .001000, .483375),
    "score_based_collateral": (.101858, .092679, .0177771, .063125, .472375),
    "score_based_industry": (.129771, .078018, .0144274, .063125, .440719),
    "score_based_hybrid": (.101905, .089084, .0177714, .063125, .483375),
    "industry_collateral": (.150734, .069250, .0119120, .039250, .472375),
    "industry_industry": (.144586, .064619, .0126497, .039250, .440719),
    "industry_hybrid": (.139800, .068525, .0132240, .039250, .483375),
}


def test_model_grid_sample(portfolio):
    rows = {r.model_key: r for r in rp.model_grid(portfolio).collect()}
    assert set(rows) == {f"{p}_{l}" for p, l in MODEL_PAIRS}
    for k, (pr, amr, elr, apd, algd) in GRID.items():
        r = rows[k]
        assert r.portfolio_raroc == approx(pr, abs=5e-7)
        assert r.average_minimum_rate == approx(amr, abs=5e-7)
        assert r.expected_loss_rate == approx(elr, abs=5e-8)
        assert r.average_pd == approx(apd, abs=5e-7)
        assert r.average_lgd == approx(algd, abs=5e-7)
        assert r.total_exposure == approx(30562500.0)
        assert r.total_economic_capital == approx(3667500.0)


def test_grid_equals_single_runs(portfolio):
    """The one-scan grid returns exactly what nine separate runs return."""
    grid = {r.model_key: r.asDict() for r in rp.model_grid(portfolio).collect()}
    for p, l in MODEL_PAIRS:
        single = rp.portfolio_summary(rp.price_facilities(portfolio, p, l)).first().asDict()
        for k, v in single.items():
            assert grid[f"{p}_{l}"][k] == approx(v, rel=1e-12, abs=1e-12), (p, l, k)


def test_grid_distribution_sample(portfolio):
    d = {(r.dimension, r.value): r["count"] for r in
         rp.model_grid_distribution(portfolio).filter(F.col("model_key") == "score_based_hybrid").collect()}
    assert {v: c for (dim, v), c in d.items() if dim == "risk_rating"} == \
        {"AAA": 1, "AA": 2, "A": 2, "BBB": 1, "BB": 1, "B": 1}
    assert {v: c for (dim, v), c in d.items() if dim == "pricing_recommendation"} == \
        {"HIGHLY_ATTRACTIVE": 1, "ATTRACTIVE": 3, "ACCEPTABLE": 1, "REJECT": 3}


def test_distributions_have_counts(portfolio):
    priced = rp.price_facilities(portfolio, "score_based", "hybrid")
    rd = {r.risk_rating: r["count"] for r in rp.risk_distribution(priced).collect()}
    assert sum(rd.values()) == 8 and isinstance(rd["AAA"], int)
    pdist = {r.pricing_recommendation: r["count"] for r in rp.recommendation_distribution(priced).collect()}
    assert pdist["REJECT"] == 3


def test_single_facility_request(spark):
    row = ("X1", "Req", 720, 0.4, 0.75, 8, 85, "technology", "medium", "equipment",
           "senior_secured", "term_loan", 1000000.0, 1000000.0, 0.0, 5, "developed")
    df = spark.createDataFrame([row], FACILITY_SCHEMA)
    r = rp.price_facilities(df).first()
    assert r.pd_score == 0.001
    assert r.collateral_lgd == approx(0.36) and r.industry_lgd == approx(0.5985)
    assert r.lgd_score == approx(0.47817)
    assert r.ead_amount == 1000000.0 and r.economic_capital == approx(120000.0)
    assert r.expected_loss == approx(478.17)
    assert r.raroc == approx(0.24601525) and r.minimum_rate == approx(0.04847817)


def test_hybrid_preserves_row_count(portfolio):
    assert rp.price_facilities(portfolio).count() == 8
    s = rp.portfolio_summary(rp.price_facilities(portfolio)).first()
    assert s.total_exposure == approx(30562500.0) and s.facility_count == 8
