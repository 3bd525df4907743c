"""Registered queries: name -> (Spark builder, oracle SQL or None).

Every builder takes ``(spark, sf_dir)``, reads the whole test tables through
``sources.tables`` and returns a lazy DataFrame; reporting precision is applied
last (``report``). The SQL twin computes the same rows from the same tables.
"""

from __future__ import annotations

from typing import Callable, Dict, Optional, Sequence, Tuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions import exposure, lgd, pd
from ..operators import facilities as fac
from ..operators import model_grid as grid
from ..operators import portfolio, products, quality
from ..sources import files, tables
from . import sql as S
from .report import AGG_GRID, report, sql_on_grid, sql_select

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: Dict[str, Tuple[Builder, Optional[str]]] = {}

# Product thresholds 40 / 20 make both discount tiers occur (line quantities are 1..50).
TIERED_RULES = P.ProductRules(bulk_threshold=40, medium_threshold=20)
RECESSION = P.RiskParams(economic_condition="recession")
SOVEREIGN = P.RiskParams(risk_type="sovereign")
STRESSED_EAD = P.RiskParams(stress_factor=1.5)


def register(name: str, sql: Optional[str] = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _pick(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return report(df.select(*keep))


# ------------------------------------------------------------------ sources

@register("facilities_source", f"SELECT {sql_select(S.FACILITY_COLUMNS)} FROM ({S.FACILITIES_SQL})")
def facilities_source(spark, d):
    return report(tables.facilities(spark, d))


@register("products_source", f"SELECT {sql_select(S.PRODUCT_COLUMNS)} FROM ({S.PRODUCT_LINES_SQL})")
def products_source(spark, d):
    return report(tables.product_lines(spark, d))


# ------------------------------------------------------------------ row quality

def _split_sql(source: str, columns, checks, rejected: bool) -> str:
    checked = f"SELECT *, {S.errors(checks)} AS validation_errors FROM ({source})"
    if rejected:
        cols = list(columns) + [("validation_errors", False)]
        return f"SELECT {sql_select(cols)} FROM ({checked}) WHERE validation_errors <> ''"
    return f"SELECT {sql_select(columns)} FROM ({checked}) WHERE validation_errors = ''"


@register("valid_facilities", _split_sql(S.SPOILED_FACILITIES_SQL, S.FACILITY_COLUMNS,
                                         S.FACILITY_CHECKS, False))
def valid_facilities(spark, d):
    return report(quality.split_facilities(tables.facilities(spark, d, spoiled=True))[0])


@register("rejected_facilities", _split_sql(S.SPOILED_FACILITIES_SQL, S.FACILITY_COLUMNS,
                                            S.FACILITY_CHECKS, True))
def rejected_facilities(spark, d):
    return report(quality.split_facilities(tables.facilities(spark, d, spoiled=True))[1])


@register("valid_products", _split_sql(S.SPOILED_PRODUCT_LINES_SQL, S.PRODUCT_COLUMNS,
                                       S.PRODUCT_CHECKS, False))
def valid_products(spark, d):
    return report(quality.split_products(tables.product_lines(spark, d, spoiled=True))[0])


@register("rejected_products", _split_sql(S.SPOILED_PRODUCT_LINES_SQL, S.PRODUCT_COLUMNS,
                                          S.PRODUCT_CHECKS, True))
def rejected_products(spark, d):
    return report(quality.split_products(tables.product_lines(spark, d, spoiled=True))[1])


# ------------------------------------------------------------------ products

def _product_sql(rules: P.ProductRules, upto: str) -> str:
    n = S.n
    base = (f"CASE WHEN category = 'premium' THEN cost * {n(rules.premium_multiplier)} "
            f"WHEN category = 'standard' THEN cost * {n(rules.standard_multiplier)} "
            f"ELSE cost * {n(rules.basic_multiplier)} END")
    disc = (f"CASE WHEN quantity >= {rules.bulk_threshold} THEN {n(rules.bulk_discount)} "
            f"WHEN quantity >= {rules.medium_threshold} THEN {n(rules.medium_discount)} "
            f"ELSE 0.0e0 END")
    L = S.Ladder(S.PRODUCT_LINES_SQL, S.PRODUCT_COLUMNS)
    L.add({"base_price": base})
    if upto != "base":
        L.add({"discount_rate": disc})
        L.add({"final_price": "base_price * (1.0e0 - discount_rate)"})
    return L


def _product_summary_sql(rules: P.ProductRules) -> str:
    L = _product_sql(rules, "final")
    g = lambda e, name: sql_on_grid(e, AGG_GRID[0])
    total = f"coalesce({S.exact_sum('final_price')}, 0.0e0)"
    average = f"coalesce({S.exact_avg('final_price', '1e6')}, 0.0e0)"
    sel = ", ".join([
        f"{g(total, '')} AS total_revenue",
        f"{g(average, '')} AS average_price",
        f"{g('coalesce(max(final_price), 0.0e0)', '')} AS max_price",
        f"{g('coalesce(min(final_price), 0.0e0)', '')} AS min_price",
        "CAST(coalesce(sum(quantity), 0) AS BIGINT) AS total_quantity",
        "count(*) AS total_products"])
    return L.sql(f"SELECT {sel} FROM {L.last}")


@register("product_base_price", _product_sql(TIERED_RULES, "base").final())
def product_base_price(spark, d):
    return report(products.add_base_price(tables.product_lines(spark, d), TIERED_RULES))


@register("product_discount", _product_sql(TIERED_RULES, "final").final(
    ["product_id", "quantity", "discount_rate"]))
def product_discount(spark, d):
    priced = products.price_products(tables.product_lines(spark, d), TIERED_RULES)
    return _pick(priced, ["product_id", "quantity", "discount_rate"])


@register("product_final_price", _product_sql(TIERED_RULES, "final").final())
def product_final_price(spark, d):
    return report(products.price_products(tables.product_lines(spark, d), TIERED_RULES))


@register("product_summary", _product_summary_sql(TIERED_RULES))
def product_summary(spark, d):
    priced = products.price_products(tables.product_lines(spark, d), TIERED_RULES)
    return report(portfolio.product_summary(priced), AGG_GRID)


@register("product_summary_default_rules", _product_summary_sql(P.ProductRules()))
def product_summary_default_rules(spark, d):
    priced = products.price_products(tables.product_lines(spark, d))
    return report(portfolio.product_summary(priced), AGG_GRID)


def _through_json(priced: DataFrame, key: str) -> DataFrame:
    """Rows written as JSON and parsed back with their schema."""
    return files.as_json(priced, key).select(F.from_json("json", priced.schema).alias("r")).select("r.*")


@register("priced_products_json", _product_sql(TIERED_RULES, "final").final())
def priced_products_json(spark, d):
    priced = products.price_products(tables.product_lines(spark, d), TIERED_RULES)
    return report(_through_json(priced, "product_id"))


# ------------------------------------------------------------------ PD

def _facility_ladder(extra: Dict[str, str], source: str = S.FACILITIES_SQL) -> "S.Ladder":
    L = S.Ladder(source, S.FACILITY_COLUMNS)
    return L.add(extra)


FCOLS = [c for c, _ in S.FACILITY_COLUMNS]


@register("pd_logistic_score", _facility_ladder(
    {"pd_linear_score": S.logistic_z(P.RiskParams(), FCOLS)}).final(["borrower_id", "pd_linear_score"]))
def pd_logistic_score(spark, d):
    f = tables.facilities(spark, d)
    z = pd.logistic_score(f.columns, P.LogisticModel())
    return report(f.select("borrower_id", z.alias("pd_linear_score")))


@register("pd_logistic", S.pricing_ladder("logistic", "hybrid", upto="pd").final(
    ["borrower_id", "pd_score"]))
def pd_logistic(spark, d):
    return _pick(fac.add_pd(tables.facilities(spark, d), "logistic"), ["borrower_id", "pd_score"])


@register("pd_score_bucket", _facility_ladder({"bucket_pd": S.bands(
    "credit_score", S.Card.SCORE_PD_BUCKETS, ">=", S.Card.SCORE_PD_OTHERWISE)}).final(
    ["borrower_id", "credit_score", "bucket_pd"]))
def pd_score_bucket(spark, d):
    f = tables.facilities(spark, d)
    return report(f.select("borrower_id", "credit_score", pd.score_bucket_pd().alias("bucket_pd")))


@register("pd_score_based", S.pricing_ladder("score_based", "hybrid", upto="pd").final(
    ["borrower_id", "credit_score", "debt_to_income", "pd_score"]))
def pd_score_based(spark, d):
    return _pick(fac.add_pd(tables.facilities(spark, d), "score_based"),
                 ["borrower_id", "credit_score", "debt_to_income", "pd_score"])


@register("pd_industry_base", _facility_ladder({"industry_base_pd": S.lookup(
    "industry", S.Card.INDUSTRY_PD, S.Card.INDUSTRY_PD_DEFAULT)}).final(
    ["borrower_id", "industry", "industry_base_pd"]))
def pd_industry_base(spark, d):
    f = tables.facilities(spark, d)
    return report(f.select("borrower_id", "industry", pd.industry_base_pd().alias("industry_base_pd")))


@register("pd_industry", S.pricing_ladder("industry", "hybrid", upto="pd").final(
    ["borrower_id", "industry", "company_size", "pd_score"]))
def pd_industry(spark, d):
    return _pick(fac.add_pd(tables.facilities(spark, d), "industry"),
                 ["borrower_id", "industry", "company_size", "pd_score"])


# ------------------------------------------------------------------ LGD

_COLL = ["borrower_id", "base_lgd", "ltv_adjustment", "seniority_adjustment", "lgd_score"]
_HYB = _COLL + ["collateral_lgd", "industry_lgd"]


def _parts_sql(name: str, keep):
    return _facility_ladder({name: S.collateral_parts(FCOLS)[name]}).final(keep)


@register("lgd_collateral_base", _parts_sql("base_lgd", ["borrower_id", "collateral_type", "base_lgd"]))
def lgd_collateral_base(spark, d):
    f = tables.facilities(spark, d)
    return report(f.select("borrower_id", "collateral_type", lgd.collateral_base().alias("base_lgd")))


@register("lgd_ltv_adjustment", _parts_sql("ltv_adjustment",
                                           ["borrower_id", "loan_to_value", "ltv_adjustment"]))
def lgd_ltv_adjustment(spark, d):
    f = tables.facilities(spark, d)
    return report(f.select("borrower_id", "loan_to_value",
                           lgd.ltv_adjustment(f.columns).alias("ltv_adjustment")))


@register("lgd_seniority_adjustment", _parts_sql("seniority_adjustment",
                                                 ["borrower_id", "seniority", "seniority_adjustment"]))
def lgd_seniority_adjustment(spark, d):
    f = tables.facilities(spark, d)
    return report(f.select("borrower_id", "seniority",
                           lgd.seniority_adjustment(f.columns).alias("seniority_adjustment")))


@register("lgd_collateral", S.pricing_ladder("logistic", "collateral", upto="lgd").final(_COLL))
def lgd_collateral(spark, d):
    return _pick(fac.add_lgd(tables.facilities(spark, d), "collateral"), _COLL)


@register("lgd_collateral_recession",
          S.pricing_ladder("logistic", "collateral", RECESSION, upto="lgd").final(_COLL))
def lgd_collateral_recession(spark, d):
    return _pick(fac.add_lgd(tables.facilities(spark, d), "collateral", RECESSION), _COLL)


@register("lgd_industry_base", _facility_ladder({"industry_base_lgd": S.lookup(
    "industry", S.Card.INDUSTRY_LGD, S.Card.INDUSTRY_LGD_DEFAULT)}).final(
    ["borrower_id", "industry", "industry_base_lgd"]))
def lgd_industry_base(spark, d):
    f = tables.facilities(spark, d)
    return report(f.select("borrower_id", "industry", lgd.industry_base().alias("industry_base_lgd")))


@register("lgd_industry", S.pricing_ladder("logistic", "industry", upto="lgd").final(
    ["borrower_id", "industry", "company_size", "region", "lgd_score"]))
def lgd_industry(spark, d):
    return _pick(fac.add_lgd(tables.facilities(spark, d), "industry"),
                 ["borrower_id", "industry", "company_size", "region", "lgd_score"])


def _blend_sql() -> str:
    L = S.pricing_ladder("logistic", "hybrid", upto="lgd")
    L.add({"hybrid_blend": (f"(collateral_lgd * {S.n(S.Card.HYBRID_COLLATERAL_WEIGHT)}) + "
                            f"(industry_lgd * {S.n(S.Card.HYBRID_INDUSTRY_WEIGHT)})")})
    return L.final(["borrower_id", "collateral_lgd", "industry_lgd", "hybrid_blend"])


@register("lgd_hybrid_blend", _blend_sql())
def lgd_hybrid_blend(spark, d):
    h = fac.add_lgd(tables.facilities(spark, d), "hybrid")
    blend = lgd.hybrid_blend(F.col("collateral_lgd"), F.col("industry_lgd"))
    return report(h.select("borrower_id", "collateral_lgd", "industry_lgd",
                           blend.alias("hybrid_blend")))


@register("lgd_hybrid", S.pricing_ladder("logistic", "hybrid", upto="lgd").final(_HYB))
def lgd_hybrid(spark, d):
    return _pick(fac.add_lgd(tables.facilities(spark, d), "hybrid"), _HYB)


# ------------------------------------------------------------------ EAD and capital

def _ead_sql(rp: P.RiskParams, source: str, columns, keep) -> str:
    return S.pricing_ladder("logistic", "hybrid", rp, source, columns, upto="capital").final(keep)


_NO_UNDRAWN_COLS = [c for c in S.FACILITY_COLUMNS if c[0] != "undrawn_amount"]
_NO_UNDRAWN_SQL = f"SELECT * EXCLUDE (undrawn_amount) FROM ({S.FACILITIES_SQL})"


@register("ead_ccf", _facility_ladder({"ccf": S.lookup("facility_type", S.Card.CCF, S.Card.CCF_DEFAULT)}).final(
    ["borrower_id", "facility_type", "ccf"]))
def ead_ccf(spark, d):
    f = tables.facilities(spark, d)
    return report(f.select("borrower_id", "facility_type", exposure.ccf().alias("ccf")))


@register("ead_detailed", _ead_sql(P.RiskParams(), S.FACILITIES_SQL, S.FACILITY_COLUMNS,
                                   ["borrower_id", "ccf", "ead_amount"]))
def ead_detailed(spark, d):
    return _pick(fac.add_exposure(tables.facilities(spark, d)), ["borrower_id", "ccf", "ead_amount"])


@register("ead_fallback", _ead_sql(P.RiskParams(), _NO_UNDRAWN_SQL, _NO_UNDRAWN_COLS,
                                   ["borrower_id", "ccf", "ead_amount"]))
def ead_fallback(spark, d):
    f = tables.facilities(spark, d).drop("undrawn_amount")
    return _pick(fac.add_exposure(f), ["borrower_id", "ccf", "ead_amount"])


@register("ead_stressed", _ead_sql(STRESSED_EAD, S.FACILITIES_SQL, S.FACILITY_COLUMNS,
                                   ["borrower_id", "ccf", "ead_amount"]))
def ead_stressed(spark, d):
    return _pick(fac.add_exposure(tables.facilities(spark, d), STRESSED_EAD),
                 ["borrower_id", "ccf", "ead_amount"])


@register("regulatory_capital", _ead_sql(P.RiskParams(), S.FACILITIES_SQL, S.FACILITY_COLUMNS,
                                         ["borrower_id", "ead_amount", "regulatory_capital"]))
def regulatory_capital(spark, d):
    f = fac.add_capital(fac.add_exposure(tables.facilities(spark, d)))
    return _pick(f, ["borrower_id", "ead_amount", "regulatory_capital"])


@register("economic_capital", _ead_sql(P.RiskParams(), S.FACILITIES_SQL, S.FACILITY_COLUMNS,
                                       ["borrower_id", "regulatory_capital", "economic_capital"]))
def economic_capital(spark, d):
    f = fac.add_capital(fac.add_exposure(tables.facilities(spark, d)))
    return _pick(f, ["borrower_id", "regulatory_capital", "economic_capital"])


# ------------------------------------------------------------------ returns, minimum price, decisions

def _priced(spark, d, pd_model="logistic", lgd_model="hybrid", rp=None, source=None):
    f = source if source is not None else tables.facilities(spark, d)
    return fac.price_facilities(f, pd_model, lgd_model, rp)


def _steps(name: str, keep: Sequence[str], pd_model: str = "logistic", lgd_model: str = "hybrid",
           rp: P.RiskParams | None = None, with_rates: bool = False) -> None:
    source = S.FACILITIES_WITH_RATES_SQL if with_rates else S.FACILITIES_SQL
    cols = S.FACILITY_COLUMNS + ([("interest_rate", True), ("fee_rate", True)] if with_rates else [])
    sql = S.pricing_ladder(pd_model, lgd_model, rp, source, cols).final(keep)

    def build(spark, d):
        src = tables.facilities_with_rates(spark, d) if with_rates else None
        return _pick(_priced(spark, d, pd_model, lgd_model, rp, src), keep)
    build.__name__ = name
    register(name, sql)(build)


_steps("expected_loss", ["borrower_id", "pd_score", "lgd_score", "ead_amount", "expected_loss"])
_steps("cost_components", ["borrower_id", "ead_amount", "funding_cost", "operational_cost"])
_steps("revenue_components", ["borrower_id", "interest_revenue", "fee_revenue", "total_revenue"])
_steps("revenue_with_rates", ["borrower_id", "interest_revenue", "fee_revenue", "total_revenue",
                              "net_income", "raroc"], with_rates=True)
_steps("net_income", ["borrower_id", "total_revenue", "expected_loss", "net_income"])
_steps("raroc", ["borrower_id", "net_income", "economic_capital", "raroc", "risk_adjusted_margin"])
_steps("raroc_sovereign", ["borrower_id", "economic_capital", "raroc", "risk_adjusted_margin",
                           "pricing_recommendation"], rp=SOVEREIGN)
_steps("minimum_price", ["borrower_id", "required_revenue", "minimum_rate"])
_steps("price_components", ["borrower_id", "minimum_rate", "base_rate_component",
                            "risk_premium_component", "operational_component", "capital_component"])
_steps("risk_rating", ["borrower_id", "pd_score", "risk_rating"], pd_model="score_based")
_steps("pricing_recommendation", ["borrower_id", "raroc", "pricing_recommendation"],
       pd_model="score_based")
_steps("competitive_rate", ["borrower_id", "minimum_rate", "competitive_rate"])
_steps("stress_test", ["borrower_id", "stress_expected_loss", "stress_minimum_rate"])


# ------------------------------------------------------------------ full pricing, 9 model pairs

def _register_pricing(pd_model: str, lgd_model: str) -> None:
    name = ("price_facilities" if (pd_model, lgd_model) == ("logistic", "hybrid")
            else f"price_facilities_{pd_model}_{lgd_model}")

    def build(spark, d):
        return report(_priced(spark, d, pd_model, lgd_model))
    build.__name__ = name
    register(name, S.priced_sql(pd_model, lgd_model))(build)


for _p, _l in grid.MODEL_PAIRS:
    _register_pricing(_p, _l)


@register("priced_facilities_json", S.priced_sql("logistic", "hybrid"))
def priced_facilities_json(spark, d):
    return report(_through_json(_priced(spark, d), "borrower_id"))


# ------------------------------------------------------------------ checked pricing

_VALID_SQL = f"SELECT * FROM ({S.SPOILED_FACILITIES_SQL}) WHERE {S.errors(S.FACILITY_CHECKS)} = ''"


@register("priced_valid_facilities", S.pricing_ladder("logistic", "hybrid", None, _VALID_SQL).final())
def priced_valid_facilities(spark, d):
    """The spoiled feed as the jobs treat it: checked first, valid rows priced."""
    valid = quality.split_facilities(tables.facilities(spark, d, spoiled=True))[0]
    return report(_priced(spark, d, source=valid))


# ------------------------------------------------------------------ parameters and optional inputs

_VARIANT_COLUMNS = ["borrower_id", "pd_score", "lgd_score", "ead_amount", "regulatory_capital", "economic_capital",
                    "expected_loss", "net_income", "raroc", "minimum_rate", "competitive_rate", "stress_expected_loss",
                    "stress_minimum_rate", "risk_rating", "pricing_recommendation"]
_OWN_EAD_SQL = f"SELECT *, exposure_amount * 0.9e0 AS ead_amount FROM ({S.FACILITIES_SQL})"
CUSTOM_LOGISTIC = P.RiskParams(logistic=P.LogisticModel(9.0, {"credit_score": -0.012, "debt_to_income": 1.5}))


def _variant(name: str, pd_model: str = "logistic", lgd_model: str = "hybrid", rp: P.RiskParams | None = None,
             without: Sequence[str] = (), own_ead: bool = False) -> None:
    cols = [c for c in S.FACILITY_COLUMNS if c[0] not in without] + ([("ead_amount", True)] if own_ead else [])
    source = _OWN_EAD_SQL if own_ead else S.FACILITIES_SQL
    if without:
        source = f"SELECT * EXCLUDE ({', '.join(without)}) FROM ({source})"

    def build(spark, d):
        f = tables.facilities(spark, d).drop(*without)
        if own_ead:
            f = f.withColumn("ead_amount", F.col("exposure_amount") * F.lit(0.9))
        return _pick(fac.price_facilities(f, pd_model, lgd_model, rp), _VARIANT_COLUMNS)

    build.__name__ = name
    register(name, S.pricing_ladder(pd_model, lgd_model, rp, source, cols).final(_VARIANT_COLUMNS))(build)


_variant("pricing_with_own_ead", own_ead=True)
_variant("pricing_custom_logistic", rp=CUSTOM_LOGISTIC)
_variant("pricing_expansion", lgd_model="collateral", rp=P.RiskParams(economic_condition="expansion"))
_variant("pricing_unknown_economy", lgd_model="collateral", rp=P.RiskParams(economic_condition="sideways"))
for _risk_type in ("sme", "retail", "bank", "cooperative"):
    _variant(f"pricing_{_risk_type}", rp=P.RiskParams(risk_type=_risk_type))
_variant("pricing_other_targets", "score_based", rp=P.RiskParams(
    target_raroc=0.12, competitive_margin=0.035, stress_pd_factor=3.0, stress_lgd_factor=1.1))
for _missing, _pd_name, _lgd_name in (("loan_to_value", "logistic", "collateral"), ("seniority", "score_based", "collateral"),
                                      ("company_size", "industry", "industry"), ("region", "industry", "industry"),
                                      ("loan_term", "score_based", "hybrid"), ("undrawn_amount", "logistic", "hybrid"),
                                      ("debt_to_income", "score_based", "hybrid")):
    _variant(f"pricing_without_{_missing}", _pd_name, _lgd_name, without=[_missing])


# ------------------------------------------------------------------ aggregations

def _summary_sql(pd_model="logistic", lgd_model="hybrid", source=S.FACILITIES_SQL) -> str:
    return (f"SELECT {S.summary_select()} FROM "
            f"({S.raw_priced(pd_model, lgd_model, source_sql=source)})")


@register("portfolio_summary", _summary_sql())
def portfolio_summary(spark, d):
    return report(portfolio.portfolio_summary(_priced(spark, d)), AGG_GRID)


_EMPTY_SOURCE = (f"SELECT * FROM ({S.FACILITIES_SQL}) WHERE "
                 f"{S.errors(S.FACILITY_CHECKS)} <> ''")


@register("portfolio_summary_empty", _summary_sql(source=_EMPTY_SOURCE))
def portfolio_summary_empty(spark, d):
    """Summary of the quarantined part of the clean feed: no rows, so every total,
    average and ratio takes its empty-input default (0, EL-rate denominator 1)."""
    rejected = quality.split_facilities(tables.facilities(spark, d))[1].drop("validation_errors")
    return report(portfolio.portfolio_summary(_priced(spark, d, source=rejected)), AGG_GRID)


@register("portfolio_summary_valid", _summary_sql(source=_VALID_SQL))
def portfolio_summary_valid(spark, d):
    """Totals of the spoiled feed's valid rows only."""
    valid = quality.split_facilities(tables.facilities(spark, d, spoiled=True))[0]
    return report(portfolio.portfolio_summary(_priced(spark, d, source=valid)), AGG_GRID)


def _report_sql() -> str:
    priced = S.raw_priced("score_based", "hybrid")
    parts = [f"SELECT '{name}' AS dimension, {column} AS value, count(*) AS count FROM p GROUP BY {column}"
             for name, column in (("risk_distribution", "risk_rating"), ("recommendation_distribution", "pricing_recommendation"))]
    return (f"WITH p AS MATERIALIZED ({priced}), t AS (SELECT {S.summary_select()} FROM p), d AS ({' UNION ALL '.join(parts)}) "
            "SELECT d.*, t.* FROM d, t")


@register("portfolio_report", _report_sql())
def portfolio_report(spark, d):
    """Totals, ratios and both distributions from one pass, a row a distribution value."""
    names = ("risk_distribution", "recommendation_distribution")
    r = report(portfolio.portfolio_report(_priced(spark, d, "score_based", "hybrid")), AGG_GRID)
    def named(n: str):
        return F.transform(n, lambda x: F.struct(F.lit(n).alias("dimension"), x["value"].alias("value"), x["count"].alias("count")))

    each = F.concat(*[named(n) for n in names])
    return r.select(F.explode(each).alias("_x"), *[c for c in r.columns if c not in names]).select("_x.*", *[c for c in r.columns if c not in names])


def _distribution_sql(column: str, pd_model="logistic", lgd_model="hybrid") -> str:
    return (f"SELECT {column}, count(*) AS count FROM "
            f"({S.raw_priced(pd_model, lgd_model)}) GROUP BY {column}")


@register("risk_distribution", _distribution_sql("risk_rating"))
def risk_distribution(spark, d):
    return portfolio.risk_distribution(_priced(spark, d))


@register("recommendation_distribution", _distribution_sql("pricing_recommendation"))
def recommendation_distribution(spark, d):
    return portfolio.recommendation_distribution(_priced(spark, d))


def _grid_sql() -> str:
    parts = []
    for p, l in grid.MODEL_PAIRS:
        keys = [f"'{p}_{l}' AS model_key", f"'{p}' AS pd_model", f"'{l}' AS lgd_model"]
        parts.append(f"SELECT {S.summary_select(keys=keys)} FROM ({S.raw_priced(p, l)})")
    return "\nUNION ALL\n".join(parts)


@register("model_grid", _grid_sql())
def model_grid(spark, d):
    return report(grid.model_grid(tables.facilities(spark, d)), AGG_GRID)


def _grid_rows_sql() -> str:
    parts = []
    for p, l in grid.MODEL_PAIRS:
        L = S.pricing_ladder(p, l)
        cols = [c for c in L.columns if c[0] in grid.GRID_ROW_COLUMNS]
        parts.append(L.sql(f"SELECT '{p}_{l}' AS model_key, '{p}' AS pd_model, '{l}' AS lgd_model, "
                           f"{sql_select(cols)} FROM {L.last}"))
    return "\nUNION ALL\n".join(f"({x})" for x in parts)


@register("model_grid_rows", _grid_rows_sql())
def model_grid_rows(spark, d):
    return report(grid.model_grid_rows(tables.facilities(spark, d)))


def _grid_distribution_sql() -> str:
    parts = []
    for p, l in grid.MODEL_PAIRS:
        for dim in ("risk_rating", "pricing_recommendation"):
            parts.append(f"SELECT '{p}_{l}' AS model_key, '{dim}' AS dimension, {dim} AS value, "
                         f"count(*) AS count FROM ({S.raw_priced(p, l)}) GROUP BY {dim}")
    return "\nUNION ALL\n".join(f"({x})" for x in parts)


@register("model_grid_distribution", _grid_distribution_sql())
def model_grid_distribution(spark, d):
    return grid.model_grid_distribution(tables.facilities(spark, d))


def queries() -> Dict[str, Builder]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> Dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
