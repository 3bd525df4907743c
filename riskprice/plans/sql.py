"""SQL text of the oracle: the same feeds and formulas written as plain SQL.

The feed derivations are the statements documented in FIXTURES.md; the pricing
chain is a ladder of CTEs, one per step, with rate cards interpolated as DOUBLE
literals. Runs on DuckDB (and mostly on Spark SQL).
"""

from __future__ import annotations

from typing import Dict, List, Mapping, Sequence, Tuple

from .. import params as P
from ..schemas import FACILITY_SCHEMA, PRODUCT_SCHEMA
from .report import AGG_GRID, ROW_GRID, sql_num, sql_on_grid, sql_select

# FIXED VALUES, written here a second time on purpose: the oracle does not share the
# library's rate cards or rules, so a wrong digit on one side shows.
class Card:
    CCF = {"term_loan": 1.0, "revolving_credit": 0.75, "letter_of_credit": 0.5, "guarantee": 1.0, "commitment": 0.3}
    CCF_DEFAULT = 0.75
    COLLATERAL_LGD = {"real_estate": 0.25, "equipment": 0.45, "inventory": 0.65, "accounts_receivable": 0.55,
        "cash_securities": 0.05, "personal_guarantee": 0.75, "unsecured": 0.85}
    COLLATERAL_LGD_DEFAULT = 0.7
    DTI_PD_UPLIFT = ((0.5, 1.5), (0.4, 1.2))
    ECONOMIC_CONDITION_DEFAULT = 1.0
    ECONOMIC_CONDITION_LGD = {"recession": 1.3, "normal": 1.0, "expansion": 0.9}
    HYBRID_COLLATERAL_WEIGHT = 0.6
    HYBRID_INDUSTRY_WEIGHT = 0.4
    INDUSTRY_LGD = {"real_estate": 0.3, "manufacturing": 0.4, "energy": 0.35, "transportation": 0.45, "technology":
        0.7, "services": 0.75, "healthcare": 0.5, "retail": 0.6, "financial_services": 0.65, "hospitality": 0.55}
    INDUSTRY_LGD_DEFAULT = 0.6
    INDUSTRY_PD = {"technology": 0.015, "healthcare": 0.02, "financial_services": 0.025, "manufacturing": 0.035,
        "retail": 0.045, "energy": 0.055, "real_estate": 0.065, "hospitality": 0.08}
    INDUSTRY_PD_DEFAULT = 0.04
    LGD_CAP = 0.95
    LGD_FLOOR = 0.05
    LTV_LGD_BANDS = ((0.5, 0.8), (0.7, 0.9), (0.8, 1.0), (0.9, 1.2))
    LTV_LGD_OTHERWISE = 1.4
    PD_CAP = 0.99
    PD_FLOOR = 0.001
    RATING_BANDS = (("AAA", 0.01), ("AA", 0.02), ("A", 0.05), ("BBB", 0.1), ("BB", 0.2), ("B", 0.3))
    RATING_OTHERWISE = "CCC"
    RECOMMENDATION_BANDS = (("HIGHLY_ATTRACTIVE", 1.5), ("ATTRACTIVE", 1.0), ("ACCEPTABLE", 0.8), ("MARGINAL", 0.5))
    RECOMMENDATION_OTHERWISE = "REJECT"
    REGION_LGD_MULTIPLIER = {"developed": 0.9, "emerging": 1.2}
    REGULATORY_CAPITAL_DEFAULT = 0.08
    REGULATORY_CAPITAL_RATE = {"corporate": 0.08, "sme": 0.075, "retail": 0.035, "sovereign": 0.0, "bank": 0.02}
    SCORE_PD_BUCKETS = ((800, 0.002), (750, 0.005), (700, 0.015), (650, 0.035), (600, 0.075), (550, 0.15))
    SCORE_PD_OTHERWISE = 0.25
    SENIORITY_LGD = {"senior_secured": 0.8, "senior_unsecured": 1.0, "subordinated": 1.3}
    SENIORITY_LGD_DEFAULT = 1.0
    SIZE_LGD_MULTIPLIER = {"large": 0.85, "medium": 0.95, "small": 1.1}
    SIZE_PD_MULTIPLIER = {"large": 0.8, "medium": 0.9, "small": 1.2}
    TERM_LGD_UPLIFT = ((5, 1.1), (3, 1.05))


FACILITY_CHECKS = (
    ("borrower_id_required", "borrower_id IS NOT NULL"),
    ("borrower_name_required", "borrower_name IS NOT NULL"),
    ("credit_score_range", "credit_score IS NOT NULL AND credit_score >= 300 AND credit_score <= 850"),
    ("debt_to_income_range", "debt_to_income IS NOT NULL AND NOT isnan(debt_to_income) AND debt_to_income >= 0 AND debt_to_income <= 2"),
    ("loan_to_value_range", "loan_to_value IS NOT NULL AND NOT isnan(loan_to_value) AND loan_to_value >= 0 AND loan_to_value <= 1.5"),
    ("employment_years_range", "employment_years IS NOT NULL AND employment_years >= 0"),
    ("payment_history_score_range", "payment_history_score IS NOT NULL AND payment_history_score >= 0 AND payment_history_score <= 100"),
    ("industry_required", "industry IS NOT NULL"),
    ("company_size_required", "company_size IS NOT NULL"),
    ("collateral_type_required", "collateral_type IS NOT NULL"),
    ("seniority_required", "seniority IS NOT NULL"),
    ("facility_type_required", "facility_type IS NOT NULL"),
    ("exposure_amount_range", "exposure_amount IS NOT NULL AND NOT isnan(exposure_amount) AND exposure_amount > 0"),
    ("outstanding_amount_range", "outstanding_amount IS NOT NULL AND NOT isnan(outstanding_amount) AND outstanding_amount >= 0"),
    ("undrawn_amount_range", "undrawn_amount IS NOT NULL AND NOT isnan(undrawn_amount) AND undrawn_amount >= 0"),
    ("loan_term_range", "loan_term IS NOT NULL AND loan_term > 0"),
    ("region_required", "region IS NOT NULL"),
)
PRODUCT_CHECKS = (
    ("product_id_required", "product_id IS NOT NULL"),
    ("name_required", "name IS NOT NULL"),
    ("category_required", "category IS NOT NULL"),
    ("cost_range", "cost IS NOT NULL AND NOT isnan(cost) AND cost > 0"),
    ("quantity_range", "quantity IS NOT NULL AND quantity > 0"),
)
# end of fixed values


def errors(checks) -> str:
    """Comma-joined names of the checks that a row fails."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{name}' END" for name, c in checks) + ")"


# ---------------------------------------------------------------- feeds

FACILITIES_SQL = """SELECT CAST(o_orderkey AS STRING) AS borrower_id, c_name AS borrower_name,
 CAST(300 + (o_orderkey*7919 + o_custkey*104729) % 551 AS INT) AS credit_score,
 CAST((o_orderkey*31 + 7) % 201 AS DOUBLE)/CAST(100 AS DOUBLE) AS debt_to_income,
 CAST((o_orderkey*17 + o_custkey) % 151 AS DOUBLE)/CAST(100 AS DOUBLE) AS loan_to_value,
 CAST(o_custkey % 21 AS INT) AS employment_years,
 CAST((o_orderkey*3 + o_custkey) % 101 AS INT) AS payment_history_score,
 CASE o_orderkey % 12 WHEN 0 THEN 'technology' WHEN 1 THEN 'healthcare' WHEN 2 THEN 'financial_services'
  WHEN 3 THEN 'manufacturing' WHEN 4 THEN 'retail' WHEN 5 THEN 'energy' WHEN 6 THEN 'real_estate'
  WHEN 7 THEN 'hospitality' WHEN 8 THEN 'transportation' WHEN 9 THEN 'services' WHEN 10 THEN 'agriculture' ELSE 'mining' END AS industry,
 CASE WHEN c_acctbal >= 6000 THEN 'large' WHEN c_acctbal >= 2000 THEN 'medium' WHEN c_acctbal >= 0 THEN 'small' ELSE 'micro' END AS company_size,
 CASE o_custkey % 8 WHEN 0 THEN 'real_estate' WHEN 1 THEN 'equipment' WHEN 2 THEN 'inventory' WHEN 3 THEN 'accounts_receivable'
  WHEN 4 THEN 'cash_securities' WHEN 5 THEN 'personal_guarantee' WHEN 6 THEN 'unsecured' ELSE 'other' END AS collateral_type,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'senior_secured' WHEN '2-HIGH' THEN 'senior_secured' WHEN '3-MEDIUM' THEN 'senior_unsecured'
  WHEN '5-LOW' THEN 'subordinated' ELSE 'mezzanine' END AS seniority,
 CASE (o_orderkey + o_custkey) % 6 WHEN 0 THEN 'term_loan' WHEN 1 THEN 'revolving_credit' WHEN 2 THEN 'letter_of_credit'
  WHEN 3 THEN 'guarantee' WHEN 4 THEN 'commitment' ELSE 'overdraft' END AS facility_type,
 o_totalprice AS exposure_amount,
 o_totalprice * CASE o_orderstatus WHEN 'F' THEN CAST(1 AS DOUBLE) WHEN 'P' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END AS outstanding_amount,
 o_totalprice * CASE o_orderstatus WHEN 'F' THEN CAST(0 AS DOUBLE) WHEN 'P' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END AS undrawn_amount,
 CAST(1 + o_orderkey % 15 AS INT) AS loan_term,
 CASE r_name WHEN 'EUROPE' THEN 'developed' WHEN 'AMERICA' THEN 'developed' WHEN 'MIDDLE EAST' THEN 'frontier' ELSE 'emerging' END AS region
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

SPOILED_FACILITIES_SQL = f"""SELECT * REPLACE (
 CASE WHEN CAST(borrower_id AS BIGINT) % 97 = 0 THEN 1000 ELSE credit_score END AS credit_score,
 CASE WHEN CAST(borrower_id AS BIGINT) % 89 = 0 THEN -0.5e0 ELSE debt_to_income END AS debt_to_income)
FROM ({FACILITIES_SQL})"""

FACILITIES_WITH_RATES_SQL = f"""SELECT *,
 CAST(300 + CAST(borrower_id AS BIGINT) % 701 AS DOUBLE)/CAST(100 AS DOUBLE)/CAST(100 AS DOUBLE) AS interest_rate,
 CAST(CAST(borrower_id AS BIGINT) % 51 AS DOUBLE)/CAST(100 AS DOUBLE)/CAST(100 AS DOUBLE) AS fee_rate
FROM ({FACILITIES_SQL})"""

_PRODUCT_LINES = """SELECT CAST(p_partkey AS STRING) AS product_id, p_name AS name,
 {category} AS category,
 p_retailprice AS cost, {quantity} AS quantity
FROM lineitem JOIN part ON l_partkey = p_partkey"""
_CATEGORY = "CASE WHEN p_type IN ('PROMO','LARGE') THEN 'premium' WHEN p_type IN ('STANDARD','MEDIUM') THEN 'standard' ELSE 'basic' END"
_QUANTITY = "CAST(l_quantity AS INT)"
PRODUCT_LINES_SQL = _PRODUCT_LINES.format(category=_CATEGORY, quantity=_QUANTITY)
SPOILED_PRODUCT_LINES_SQL = _PRODUCT_LINES.format(
    category=f"CASE WHEN l_orderkey % 89 = 0 THEN CAST(NULL AS STRING) ELSE {_CATEGORY} END",
    quantity=f"CASE WHEN l_orderkey % 97 = 0 THEN 0 ELSE {_QUANTITY} END")

FACILITY_COLUMNS: List[Tuple[str, bool]] = [
    (f.name, f.dataType.typeName() == "double") for f in FACILITY_SCHEMA.fields]
PRODUCT_COLUMNS: List[Tuple[str, bool]] = [
    (f.name, f.dataType.typeName() == "double") for f in PRODUCT_SCHEMA.fields]

# ---------------------------------------------------------------- expression helpers

n = sql_num


def lookup(key: str, card: Mapping[str, float], default: float) -> str:
    whens = " ".join(f"WHEN {key} = '{k}' THEN {n(v)}" for k, v in card.items())
    return f"CASE {whens} ELSE {n(default)} END"


def bands(value: str, table, op: str, otherwise) -> str:
    def lit(x):
        return f"'{x}'" if isinstance(x, str) else n(x)
    whens = " ".join(f"WHEN {value} {op} {lit(b)} THEN {lit(o)}" for b, o in table)
    return f"CASE {whens} ELSE {lit(otherwise)} END"


def logistic_z(rp: P.RiskParams, columns: Sequence[str]) -> str:
    z = n(rp.logistic.intercept)
    for feature, coef in rp.logistic.coefficients.items():
        if feature in columns:
            z = f"({z} + {feature} * {n(coef)})"
    return z


def pd_expr(model: str, rp: P.RiskParams, columns: Sequence[str]) -> str:
    if model == "logistic":
        raw = f"(1.0e0 / (1.0e0 + exp(-{logistic_z(rp, columns)})))"
        return (f"CASE WHEN {raw} > {n(Card.PD_CAP)} THEN {n(Card.PD_CAP)} "
                f"WHEN {raw} < {n(Card.PD_FLOOR)} THEN {n(Card.PD_FLOOR)} ELSE {raw} END")
    if model == "score_based":
        b = bands("credit_score", Card.SCORE_PD_BUCKETS, ">=", Card.SCORE_PD_OTHERWISE)
        if "debt_to_income" not in columns:
            return b
        return f"({b}) * ({bands('debt_to_income', Card.DTI_PD_UPLIFT, '>', 1.0)})"
    if model == "industry":
        b = lookup("industry", Card.INDUSTRY_PD, Card.INDUSTRY_PD_DEFAULT)
        if "company_size" not in columns:
            return b
        return f"({b}) * ({lookup('company_size', Card.SIZE_PD_MULTIPLIER, 1.0)})"
    raise ValueError(model)


def collateral_parts(columns: Sequence[str]) -> Dict[str, str]:
    return {
        "base_lgd": lookup("collateral_type", Card.COLLATERAL_LGD, Card.COLLATERAL_LGD_DEFAULT),
        "ltv_adjustment": (bands("loan_to_value", Card.LTV_LGD_BANDS, "<=", Card.LTV_LGD_OTHERWISE)
                           if "loan_to_value" in columns else "1.0e0"),
        "seniority_adjustment": (lookup("seniority", Card.SENIORITY_LGD, Card.SENIORITY_LGD_DEFAULT)
                                 if "seniority" in columns else "1.0e0"),
    }


def collateral_clip(rp: P.RiskParams) -> str:
    raw = f"base_lgd * ltv_adjustment * seniority_adjustment * {n(Card.ECONOMIC_CONDITION_LGD.get(rp.economic_condition, Card.ECONOMIC_CONDITION_DEFAULT))}"
    return f"greatest(least({raw}, {n(Card.LGD_CAP)}), {n(Card.LGD_FLOOR)})"


def industry_lgd_expr(columns: Sequence[str]) -> str:
    x = lookup("industry", Card.INDUSTRY_LGD, Card.INDUSTRY_LGD_DEFAULT)
    if "company_size" in columns:
        x = f"({x}) * ({lookup('company_size', Card.SIZE_LGD_MULTIPLIER, 1.0)})"
    if "region" in columns:
        x = f"({x}) * ({lookup('region', Card.REGION_LGD_MULTIPLIER, 1.0)})"
    return f"least(greatest({x}, {n(Card.LGD_FLOOR)}), {n(Card.LGD_CAP)})"


def hybrid_expr(columns: Sequence[str]) -> str:
    x = (f"((collateral_lgd * {n(Card.HYBRID_COLLATERAL_WEIGHT)}) + "
         f"(industry_lgd * {n(Card.HYBRID_INDUSTRY_WEIGHT)}))")
    if "loan_term" in columns:
        x = f"{x} * ({bands('loan_term', Card.TERM_LGD_UPLIFT, '>', 1.0)})"
    return f"least(greatest({x}, {n(Card.LGD_FLOOR)}), {n(Card.LGD_CAP)})"


def ratio_or_zero(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN {num} / {den} ELSE 0.0e0 END"


def ratio_or_null(num: str, den: str) -> str:
    return f"({num}) / NULLIF({den}, 0)"


# ---------------------------------------------------------------- pricing ladder

class Ladder:
    """Builds ``WITH s0 AS (...), s1 AS (SELECT *, ... FROM s0) ...`` step by step."""

    def __init__(self, source_sql: str, columns: Sequence[Tuple[str, bool]]):
        self.ctes = [f"s0 AS ({source_sql})"]
        self.columns: List[Tuple[str, bool]] = list(columns)

    @property
    def last(self) -> str:
        return f"s{len(self.ctes) - 1}"

    def add(self, exprs: Mapping[str, str], double: bool = True) -> "Ladder":
        names = [c for c, _ in self.columns]
        replace = {k: v for k, v in exprs.items() if k in names}
        new = {k: v for k, v in exprs.items() if k not in names}
        star = "*"
        if replace:
            star = "* REPLACE (" + ", ".join(f"{v} AS {k}" for k, v in replace.items()) + ")"
        sel = ", ".join([star] + [f"{v} AS {k}" for k, v in new.items()])
        self.ctes.append(f"s{len(self.ctes)} AS (SELECT {sel} FROM {self.last})")
        for k in new:
            self.columns.append((k, double))
        return self

    def sql(self, select: str) -> str:
        return "WITH " + ",\n".join(self.ctes) + f"\n{select}"

    def final(self, keep: Sequence[str] = None, grid=ROW_GRID) -> str:
        cols = self.columns if keep is None else [c for c in self.columns if c[0] in keep]
        return self.sql(f"SELECT {sql_select(cols, grid)} FROM {self.last}")


def pricing_ladder(pd_model: str, lgd_model: str, rp: P.RiskParams | None = None,
                   source_sql: str = FACILITIES_SQL,
                   columns: Sequence[Tuple[str, bool]] = FACILITY_COLUMNS,
                   upto: str = "decisions") -> Ladder:
    rp = rp or P.RiskParams()
    names = [c for c, _ in columns]
    L = Ladder(source_sql, columns)
    L.add({"pd_score": pd_expr(pd_model, rp, names)})
    if upto == "pd":
        return L
    if lgd_model == "industry":
        L.add({"lgd_score": industry_lgd_expr(names)})
    else:
        L.add(collateral_parts(names))
        L.add({"lgd_score": collateral_clip(rp)})
        if lgd_model == "hybrid":
            L.add({"collateral_lgd": "lgd_score", "industry_lgd": industry_lgd_expr(names)})
            L.add({"lgd_score": hybrid_expr(names)})
    if upto == "lgd":
        return L
    if "ead_amount" not in names:
        L.add({"ccf": lookup("facility_type", Card.CCF, Card.CCF_DEFAULT)})
        if "outstanding_amount" in names and "undrawn_amount" in names:
            e = "outstanding_amount + (undrawn_amount * ccf)"
        else:
            e = "exposure_amount * ccf"
        L.add({"ead_amount": f"({e}) * {n(rp.stress_factor)}"})
    L.add({"regulatory_capital": f"ead_amount * {n(Card.REGULATORY_CAPITAL_RATE.get(rp.risk_type, Card.REGULATORY_CAPITAL_DEFAULT))}"})
    L.add({"economic_capital": f"regulatory_capital * {n(rp.economic_capital_multiplier)}"})
    if upto == "capital":
        return L
    L.add({
        "expected_loss": "pd_score * lgd_score * ead_amount",
        "funding_cost": f"ead_amount * {n(rp.funding_cost_rate)}",
        "operational_cost": f"ead_amount * {n(rp.operational_cost_rate)}",
        "interest_revenue": ("ead_amount * interest_rate" if "interest_rate" in names
                             else f"ead_amount * {n(rp.base_interest_rate)}"),
        "fee_revenue": "ead_amount * fee_rate" if "fee_rate" in names else "0.0e0",
    })
    L.add({"total_revenue": "interest_revenue + fee_revenue"})
    L.add({"net_income": "total_revenue - expected_loss - funding_cost - operational_cost"})
    L.add({"raroc": ratio_or_zero("net_income", "economic_capital"),
           "risk_adjusted_margin": ratio_or_zero("net_income", "ead_amount")})
    if upto == "returns":
        return L
    L.add({"required_revenue": ("expected_loss + funding_cost + operational_cost + "
                                f"(economic_capital * {n(rp.target_roe)})")})
    L.add({"minimum_rate": ratio_or_zero("required_revenue", "ead_amount")})
    L.add({"base_rate_component": n(rp.funding_cost_rate),
           "risk_premium_component": ratio_or_null("expected_loss", "ead_amount"),
           "operational_component": n(rp.operational_cost_rate),
           "capital_component": ratio_or_null(f"economic_capital * {n(rp.target_roe)}",
                                              "ead_amount")})
    if upto == "minimum":
        return L
    ratings = bands("pd_score", [(b, r) for r, b in Card.RATING_BANDS], "<=", Card.RATING_OTHERWISE)
    recs = bands("raroc", [(rp.target_raroc * m, lab) for lab, m in Card.RECOMMENDATION_BANDS],
                 ">=", Card.RECOMMENDATION_OTHERWISE)
    L.add({"risk_rating": ratings, "pricing_recommendation": recs}, double=False)
    L.add({"competitive_rate": f"minimum_rate + {n(rp.competitive_margin)}",
           "stress_expected_loss": (f"pd_score * {n(rp.stress_pd_factor)} * lgd_score * "
                                    f"{n(rp.stress_lgd_factor)} * ead_amount")})
    L.add({"stress_minimum_rate": ratio_or_null(
        f"stress_expected_loss + funding_cost + operational_cost + "
        f"(economic_capital * {n(rp.target_roe)})", "ead_amount")})
    return L


def priced_sql(pd_model: str, lgd_model: str, rp: P.RiskParams | None = None,
               source_sql: str = FACILITIES_SQL, keep: Sequence[str] = None) -> str:
    return pricing_ladder(pd_model, lgd_model, rp, source_sql).final(keep)


# ---------------------------------------------------------------- summaries

def exact_sum(column: str, unit: str = "1e6") -> str:
    """Order-free sum: whole units as wide decimals, scaled back at the end."""
    return f"(CAST(sum(CAST({column} * {unit} AS DECIMAL(38,0))) AS DOUBLE) / {unit})"


def exact_avg(column: str, unit: str = "1e12") -> str:
    return f"({exact_sum(column, unit)} / CAST(NULLIF(count({column}), 0) AS DOUBLE))"


def summary_select(grid=AGG_GRID, keys: Sequence[str] = ()) -> str:
    g = lambda e, name: sql_on_grid(e, grid[0] if name.startswith("total_") else grid[1])
    parts = list(keys)
    sums = {"total_exposure": "ead_amount", "total_expected_loss": "expected_loss",
            "total_economic_capital": "economic_capital", "total_net_income": "net_income"}
    for name, src in sums.items():
        parts.append(f"{g(f'coalesce({exact_sum(src)}, 0.0e0)', name)} AS {name}")
    parts.append(g(f"CASE WHEN coalesce({exact_sum('economic_capital')}, 0.0e0) > 0 THEN "
                   f"coalesce({exact_sum('net_income')}, 0.0e0) / {exact_sum('economic_capital')} ELSE 0.0e0 END",
                   "portfolio_raroc") + " AS portfolio_raroc")
    avgs = {"average_pd": "pd_score", "average_lgd": "lgd_score",
            "average_individual_raroc": "raroc", "average_minimum_rate": "minimum_rate"}
    for name, src in avgs.items():
        parts.append(f"{g(f'coalesce({exact_avg(src)}, 0.0e0)', name)} AS {name}")
    parts.append(g(f"coalesce({exact_sum('expected_loss')}, 0.0e0) / "
                   f"coalesce(NULLIF({exact_sum('ead_amount')}, 0.0e0), 1.0e0)", "expected_loss_rate")
                 + " AS expected_loss_rate")
    parts.append("count(*) AS facility_count")
    return ", ".join(parts)


def raw_priced(pd_model: str, lgd_model: str, rp: P.RiskParams | None = None,
               source_sql: str = FACILITIES_SQL) -> str:
    """Priced rows without reporting grid (input of summaries)."""
    L = pricing_ladder(pd_model, lgd_model, rp, source_sql)
    return L.sql(f"SELECT * FROM {L.last}")
