"""Boundary rows, nulls, unknown keys, missing optional columns, parameters (FIXTURES §6)."""

import pytest
from pyspark.sql import functions as F

import riskprice as rp
from riskprice.params import LogisticModel, ProductRules, RiskParams
from riskprice.schemas import FACILITY_SCHEMA
from helpers import by_id

BASE = dict(borrower_id="E", borrower_name="Edge", credit_score=700, debt_to_income=0.3,
            loan_to_value=0.6, employment_years=5, payment_history_score=80,
            industry="technology", company_size="large", collateral_type="equipment",
            seniority="senior_secured", facility_type="term_loan", exposure_amount=1000.0,
            outstanding_amount=1000.0, undrawn_amount=0.0, loan_term=2, region="developed")


def rows(spark, *changes):
    data = []
    for i, ch in enumerate(changes):
        r = dict(BASE, borrower_id=f"E{i}", **ch)
        data.append(tuple(r[f.name] for f in FACILITY_SCHEMA.fields))
    return spark.createDataFrame(data, FACILITY_SCHEMA)


def col_of(df, name):
    return [r[name] for r in df.orderBy(F.col("borrower_id").cast("string")).collect()]


def test_score_buckets_include_lower_bound(spark):
    scores = [800, 799, 750, 749, 700, 699, 650, 649, 600, 599, 550, 549, 300]
    df = rows(spark, *[dict(credit_score=s, debt_to_income=0.1) for s in scores])
    ids = sorted(range(len(scores)), key=lambda i: f"E{i}")
    got = {scores[i]: v for i, v in zip(ids, col_of(rp.add_pd(df, "score_based"), "pd_score"))}
    assert got == {800: .002, 799: .005, 750: .005, 749: .015, 700: .015, 699: .035, 650: .035,
                   649: .075, 600: .075, 599: .15, 550: .15, 549: .25, 300: .25}


def test_dti_and_term_exclude_bound(spark):
    df = rows(spark, dict(debt_to_income=0.4, credit_score=800),
              dict(debt_to_income=0.5, credit_score=800),
              dict(debt_to_income=0.51, credit_score=800))
    assert col_of(rp.add_pd(df, "score_based"), "pd_score") == pytest.approx([.002, .002 * 1.2, .002 * 1.5])
    t = rows(spark, dict(loan_term=3), dict(loan_term=4), dict(loan_term=5), dict(loan_term=6))
    h = rp.add_lgd(t, "hybrid").select("borrower_id", (F.col("lgd_score") / (
        F.col("collateral_lgd") * .6 + F.col("industry_lgd") * .4)).alias("f"))
    assert col_of(h, "f") == pytest.approx([1.0, 1.05, 1.05, 1.1])


def test_ltv_bands_include_upper_bound(spark):
    ltvs = [0.5, 0.51, 0.7, 0.8, 0.9, 0.91, None]
    df = rows(spark, *[dict(loan_to_value=v) for v in ltvs])
    assert col_of(rp.add_lgd(df, "collateral"), "ltv_adjustment") == [0.8, 0.9, 0.9, 1.0, 1.2, 1.4, 1.4]


def test_quantity_tiers_include_bound(spark):
    df = spark.createDataFrame([(str(q), "n", "basic", 10.0, q) for q in (49, 50, 99, 100, None)],
                               "product_id string, name string, category string, cost double, quantity int")
    got = {r.product_id: r.discount_rate for r in rp.price_products(df).collect()}
    assert got == {"49": 0.0, "50": 0.05, "99": 0.05, "100": 0.1, "None": 0.0}


def test_unknown_case_and_null_keys_fall_back(spark):
    df = rows(spark, dict(industry="other", company_size="other", collateral_type="other",
                          seniority="other", facility_type="other", region="other"),
              dict(industry="Technology"), dict(industry=None, company_size=None))
    pdi = col_of(rp.add_pd(df, "industry"), "pd_score")
    assert pdi == pytest.approx([.04, .04 * .8, .04])
    lc = rp.add_lgd(df, "collateral").collect()
    assert lc[0].base_lgd == .70 and lc[0].seniority_adjustment == 1.0
    assert col_of(rp.add_exposure(df), "ccf")[0] == .75
    li = col_of(rp.add_lgd(df, "industry"), "lgd_score")
    assert li[0] == pytest.approx(.60)


def test_null_feature(spark):
    df = rows(spark, dict(credit_score=None))
    r = rp.price_facilities(df).first()
    assert r.pd_score is None and r.risk_rating == "CCC" and r.pricing_recommendation == "REJECT"
    assert rp.add_pd(df, "score_based").first().pd_score == .25


def test_zero_ead(spark):
    df = rows(spark, dict(outstanding_amount=0.0, undrawn_amount=0.0))
    r = rp.price_facilities(df).first()
    assert (r.raroc, r.risk_adjusted_margin, r.minimum_rate) == (0.0, 0.0, 0.0)
    assert r.risk_premium_component is None and r.capital_component is None
    assert r.stress_minimum_rate is None


def test_sovereign(spark, portfolio):
    r = rp.price_facilities(portfolio, rp=RiskParams(risk_type="sovereign")).collect()
    assert all(x.economic_capital == 0 and x.raroc == 0.0 and x.pricing_recommendation == "REJECT"
               for x in r)


@pytest.mark.parametrize("drop", ["company_size", "region", "loan_to_value", "seniority",
                                  "loan_term", "undrawn_amount", "debt_to_income"])
def test_missing_optional_columns(spark, portfolio, drop):
    full = by_id(rp.price_facilities(portfolio, "industry", "hybrid"))
    part = by_id(rp.price_facilities(portfolio.drop(drop), "industry", "hybrid"))
    assert len(part) == 8
    r, f = part["B007"], full["B007"]
    if drop == "company_size":
        assert r["pd_score"] == pytest.approx(.015) and r["industry_lgd"] == pytest.approx(.70 * .9)
    elif drop == "region":
        assert r["industry_lgd"] == pytest.approx(.70 * 1.1)
    elif drop == "loan_to_value":
        assert r["ltv_adjustment"] == 1.0
    elif drop == "seniority":
        assert r["seniority_adjustment"] == 1.0
    elif drop == "loan_term":
        assert r["lgd_score"] == pytest.approx(r["collateral_lgd"] * .6 + r["industry_lgd"] * .4)
    elif drop == "undrawn_amount":
        assert r["ead_amount"] == pytest.approx(1000000.0 * .75)
        assert f["ead_amount"] == pytest.approx(812500.0)
    elif drop == "debt_to_income":
        sb = by_id(rp.add_pd(portfolio.drop(drop), "score_based"))
        assert sb["B003"]["pd_score"] == .075


def test_pd_cap_with_custom_coefficients(portfolio):
    params = RiskParams(logistic=LogisticModel.from_dict({"intercept": 10}))
    assert {r.pd_score for r in rp.add_pd(portfolio, "logistic", params).collect()} == {0.99}


def test_economic_condition(portfolio):
    base = by_id(rp.add_lgd(portfolio, "collateral"))
    for cond, f in (("recession", 1.3), ("expansion", 0.9), ("unknown", 1.0)):
        got = by_id(rp.add_lgd(portfolio, "collateral", RiskParams(economic_condition=cond)))
        raw = base["B001"]["base_lgd"] * base["B001"]["ltv_adjustment"] * base["B001"]["seniority_adjustment"]
        assert got["B001"]["lgd_score"] == pytest.approx(min(max(raw * f, .05), .95))
        ind = by_id(rp.add_lgd(portfolio, "industry", RiskParams(economic_condition=cond)))
        assert ind["B001"]["lgd_score"] == pytest.approx(.5355)


def test_empty_input(portfolio):
    s = rp.portfolio_summary(rp.price_facilities(portfolio.limit(0))).first()
    assert s.total_exposure == 0 and s.average_pd == 0 and s.portfolio_raroc == 0
    assert s.expected_loss_rate == 0 and s.facility_count == 0
    assert rp.risk_distribution(rp.price_facilities(portfolio.limit(0))).count() == 0


def test_ead_bypass(spark, portfolio):
    df = portfolio.withColumn("ead_amount", F.lit(100.0))
    out = rp.price_facilities(df, rp=RiskParams(stress_factor=2.0))
    assert "ccf" not in out.columns
    assert {r.ead_amount for r in out.collect()} == {100.0}


def test_stress_factor_and_rates(portfolio):
    r = by_id(rp.add_exposure(portfolio, RiskParams(stress_factor=1.5)))
    assert r["B002"]["ead_amount"] == pytest.approx(1875000 * 1.5)
    rated = portfolio.withColumns({"interest_rate": F.lit(0.07), "fee_rate": F.lit(0.01)})
    x = by_id(rp.price_facilities(rated))["B001"]
    assert x["interest_revenue"] == pytest.approx(350000.0) and x["fee_revenue"] == pytest.approx(50000.0)


def test_invariants(spark):
    from riskprice.sources import tables
    priced = rp.price_facilities(tables.facilities(spark, "/root/testdata/sf0.001"), "score_based", "hybrid")
    bad = priced.filter(
        (F.col("ead_amount") > 0) &
        (F.abs(F.col("minimum_rate") - (F.col("base_rate_component") + F.col("risk_premium_component")
                                        + F.col("operational_component") + F.col("capital_component"))) > 1e-12)
        | (F.col("lgd_score") < .05) | (F.col("lgd_score") > .95)
        | (F.col("collateral_lgd") < .05) | (F.col("industry_lgd") > .95))
    assert bad.count() == 0


def test_unknown_models_rejected(portfolio):
    with pytest.raises(ValueError):
        rp.price_facilities(portfolio, pd_model="neural")
    with pytest.raises(ValueError):
        rp.price_facilities(portfolio, lgd_model="magic")


def test_parameter_validation():
    with pytest.raises(ValueError):
        ProductRules(premium_multiplier=0)
    with pytest.raises(ValueError):
        ProductRules(bulk_discount=1.5)
    with pytest.raises(ValueError):
        RiskParams(target_raroc=0)
    with pytest.raises(ValueError):
        RiskParams(competitive_margin=-0.1)
    with pytest.raises(ValueError):
        RiskParams(stress_lgd_factor=0)
    assert ProductRules.from_dict(None) == ProductRules()
    assert ProductRules.from_dict({"bulk_threshold": 40, "base_margin": 1}).bulk_threshold == 40
    assert RiskParams.from_dict({"risk_type": "sme"}).regulatory_capital_rate == .075
    assert RiskParams(risk_type="unheard").regulatory_capital_rate == .08
    with pytest.raises(ValueError):
        LogisticModel.from_dict({"credit_score": 1.0})


def test_recommendation_thresholds_are_doubles():
    from riskprice.functions.decision import recommendation_thresholds
    t = dict(recommendation_thresholds(RiskParams()))
    assert t["HIGHLY_ATTRACTIVE"] == 0.15 * 1.5 == 0.22499999999999998


def test_model_grid_with_given_ead(portfolio):
    df = portfolio.withColumn("ead_amount", F.lit(1000.0))
    rows = rp.model_grid(df).collect()
    assert len(rows) == 9 and all(r.total_exposure == 8000.0 for r in rows)


def test_risk_params_ignore_null_entries():
    assert RiskParams.from_dict({"target_raroc": None, "coefficients": None}) == RiskParams()


def test_report_grid_passes_non_finite(spark):
    from riskprice.plans.report import report
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e300,), (0.1234567890123,), (None,)],
                               "x double")
    got = [r.x for r in report(df).collect()]
    assert got[0] != got[0] and got[1] == float("inf") and got[2] == 1e300
    assert got[3] == 0.1234567890 and got[4] is None


def test_totals_are_exact_at_any_size_and_partitioning(spark):
    from decimal import Decimal

    from riskprice.operators import portfolio as pf
    names = [src for _, src in (*pf._SUMS, *pf._AVGS)]
    rows = [tuple(float((i * 7919 + j * 104729) % 1_000_003) / 7 * (1e6 if j < 4 else 1e-6) for j in range(len(names))) for i in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    first = pf.portfolio_summary(df.coalesce(1)).first()
    assert first.total_exposure > 1e14
    for n in (2, 7, 40):
        assert pf.portfolio_summary(df.repartition(n, "ead_amount")).first() == first
    exact = sum(Decimal(r[0]) for r in rows)
    assert abs(Decimal(first.total_exposure) - exact) < Decimal("0.05")


def test_report_equals_its_parts(spark, portfolio):
    from riskprice.operators import portfolio as pf
    priced = rp.price_facilities(portfolio, "score_based")
    r, s = pf.portfolio_report(priced).first(), rp.portfolio_summary(priced).first()
    assert all(r[c] == s[c] for c in s.asDict())
    assert {(x.value, x["count"]) for x in r.risk_distribution} == {tuple(x) for x in rp.risk_distribution(priced).collect()}
    assert {(x.value, x["count"]) for x in r.recommendation_distribution} == {tuple(x) for x in rp.recommendation_distribution(priced).collect()}
    empty = pf.portfolio_report(priced.limit(0)).first()
    assert empty.facility_count == 0 and empty.total_exposure == 0.0 and empty.risk_distribution == []


def test_sums_are_exact_at_every_size(spark):
    """Totals do not depend on order or partitioning, far beyond the range of money."""
    import random
    from fractions import Fraction

    from riskprice.operators.portfolio import limb_sums, _total, MONEY_UNIT
    rng = random.Random(5)
    values = [rng.uniform(-1, 1) * 10 ** rng.uniform(-4, 16) for _ in range(4000)]
    values += [1.25e20, -1.25e20, 7.5e21, 3e14, 0.1, -0.3, 1e-7, None]
    want = float(sum(round(Fraction(v * MONEY_UNIT)) for v in values if v is not None)) / MONEY_UNIT
    got = set()
    for seed, partitions in ((1, 1), (2, 7), (3, 16)):
        random.Random(seed).shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(partitions)
        got.add(df.agg(*limb_sums("t", "x", MONEY_UNIT)).select(_total("t", MONEY_UNIT).alias("s")).first().s)
    assert got == {want}


@pytest.mark.parametrize("values, want", [([float("inf"), 1.0], float("inf")), ([float("inf"), float("-inf")], None),
                                          ([float("nan"), 2.0], None), ([1e300, 1e300], 2e300), ([None, None], "null"), ([-0.5, 0.25], -0.25)])
def test_sums_of_odd_values(spark, values, want):
    from riskprice.operators.portfolio import limb_sums, _total, MONEY_UNIT
    df = spark.createDataFrame([(v,) for v in values], "x double")
    s = df.agg(*limb_sums("t", "x", MONEY_UNIT)).select(_total("t", MONEY_UNIT).alias("s")).first().s
    assert s is None if want == "null" else s != s if want is None else s == pytest.approx(want, rel=1e-15)
