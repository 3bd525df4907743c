"""Facility pricing: PD -> LGD -> EAD -> capital -> RAROC -> minimum price -> decision.

Each step defines named column expressions on a ``Stage``; ``stage.next()`` puts them
into a projection of their own, and later steps refer to the finished columns. A
pricing run is a few stacked projections (scores, exposure and capital, losses and
revenue, ratios, decisions), so every formula stands in the plan once and each
generated method stays small; they all run in one codegen stage, without a shuffle
and without Python in the executors. The same plan runs on a stream.

The public ``add_*`` functions apply a single step and materialise its columns.
"""

from __future__ import annotations

from typing import Dict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import decision, exposure, lgd, pd, registry, returns
from ..functions.columns import compiled_apart


class Stage:
    """Ordered new/replaced columns of one projection over ``df``."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.columns = list(df.columns)
        self.exprs: Dict[str, Column] = {}

    def ref(self, name: str) -> Column:
        return self.exprs[name] if name in self.exprs else F.col(name)

    def has(self, name: str) -> bool:
        return name in self.exprs or name in self.columns

    def put(self, name: str, expr: Column) -> "Stage":
        self.exprs[name] = expr
        return self

    def next(self) -> "Stage":
        """Finish this projection; what follows sees its columns."""
        if self.exprs:
            self.df = self.df.withColumns(self.exprs)
            self.columns = list(self.df.columns)
            self.exprs = {}
        return self

    def drop(self, name: str) -> "Stage":
        self.df = self.next().df.drop(name)
        self.columns = list(self.df.columns)
        return self

    def apply(self) -> DataFrame:
        return self.next().df

    def compiled_apart(self, *names: str) -> "Stage":
        self.df = compiled_apart(self.next().df, *names)
        return self


def _pd(st: Stage, model: str, rp: P.RiskParams) -> None:
    put_pd(st, "pd_score", model, rp)


def put_pd(st: Stage, name: str, model: str, rp: P.RiskParams) -> None:
    """Column ``name`` with the PD of a model; a clip of its own where the model has one,
    as each bound refers to the unclipped value again."""
    raw = pd.unclipped_pd(model)
    if raw is None:
        st.put(name, pd.pd_model(model)(st.columns, rp))
        return
    st.put("_raw_pd", raw(st.columns, rp)).next()
    st.put(name, pd.clip_pd(F.col("_raw_pd"))).drop("_raw_pd")


def _lgd(st: Stage, model: str, rp: P.RiskParams) -> None:
    lgd.check_lgd_model(model)
    cols = st.columns
    if model in registry.LGD.own:
        st.put("lgd_score", registry.LGD.own[model].build(cols, rp))
        return
    if model == "industry":
        st.put("lgd_score", lgd.industry_lgd(cols))
        return
    for name, expr in lgd.collateral_parts(cols).items():
        st.put(name, expr)
    st.next()
    st.put("lgd_score", lgd.collateral_lgd(rp, st.ref))
    if model == "hybrid":
        st.next()
        st.put("collateral_lgd", st.ref("lgd_score"))
        st.put("industry_lgd", lgd.industry_lgd(cols))
        st.put("lgd_score", lgd.hybrid_lgd(cols, st.ref("collateral_lgd"), st.ref("industry_lgd")))


def _exposure(st: Stage, rp: P.RiskParams) -> None:
    if st.has("ead_amount"):
        return
    st.put("ccf", exposure.ccf()).next()
    st.put("ead_amount", exposure.ead(st.columns, rp, st.ref))


def _capital(st: Stage, rp: P.RiskParams) -> None:
    st.next()
    st.put("regulatory_capital", exposure.regulatory_capital(rp, st.ref)).next()
    st.put("economic_capital", exposure.economic_capital(rp, st.ref))


def _returns(st: Stage, rp: P.RiskParams) -> None:
    st.next()
    for name, expr in {**returns.loss_and_costs(rp, st.ref),
                       **returns.revenue(st.columns, rp, st.ref)}.items():
        st.put(name, expr)
    st.next()
    st.put("total_revenue", returns.total_revenue(st.ref))
    st.put("net_income", returns.net_income(st.ref)).next()
    st.put("raroc", returns.raroc(st.ref))
    st.put("risk_adjusted_margin", returns.risk_adjusted_margin(st.ref))


def _minimum_price(st: Stage, rp: P.RiskParams) -> None:
    st.next()
    st.put("required_revenue", returns.required_revenue(rp, st.ref)).next()
    st.put("minimum_rate", returns.minimum_rate(st.ref))
    for name, expr in returns.price_components(rp, st.ref).items():
        st.put(name, expr)


def _decisions(st: Stage, rp: P.RiskParams) -> None:
    st.next()
    st.put("risk_rating", decision.risk_rating(st.ref))
    st.put("pricing_recommendation", decision.pricing_recommendation(rp, st.ref))
    st.put("competitive_rate", decision.competitive_rate(rp, st.ref))
    st.put("stress_expected_loss", decision.stress_expected_loss(rp, st.ref)).next()
    st.put("stress_minimum_rate", decision.stress_minimum_rate(rp, st.ref))


def _step(fn, df: DataFrame, *args) -> DataFrame:
    st = Stage(df)
    fn(st, *args)
    return st.apply()


def add_pd(df: DataFrame, model: str = "logistic", rp: P.RiskParams | None = None) -> DataFrame:
    return _step(_pd, df, model, rp or P.RiskParams())


def add_lgd(df: DataFrame, model: str = "hybrid", rp: P.RiskParams | None = None) -> DataFrame:
    """Collateral: base_lgd, ltv_adjustment, seniority_adjustment, lgd_score.
    Industry: lgd_score. Hybrid: collateral columns + collateral_lgd, industry_lgd,
    with lgd_score the blended value. All row-local: the row count is preserved."""
    return _step(_lgd, df, model, rp or P.RiskParams())


def add_exposure(df: DataFrame, rp: P.RiskParams | None = None) -> DataFrame:
    """ccf and ead_amount; an input that already carries ead_amount is kept as is."""
    return _step(_exposure, df, rp or P.RiskParams())


def add_capital(df: DataFrame, rp: P.RiskParams | None = None) -> DataFrame:
    return _step(_capital, df, rp or P.RiskParams())


def add_returns(df: DataFrame, rp: P.RiskParams | None = None) -> DataFrame:
    """expected_loss .. risk_adjusted_margin (needs pd_score, lgd_score, ead, capital)."""
    return _step(_returns, df, rp or P.RiskParams())


def add_minimum_price(df: DataFrame, rp: P.RiskParams | None = None) -> DataFrame:
    return _step(_minimum_price, df, rp or P.RiskParams())


def add_decisions(df: DataFrame, rp: P.RiskParams | None = None) -> DataFrame:
    return _step(_decisions, df, rp or P.RiskParams())


def add_raroc(df: DataFrame, rp: P.RiskParams | None = None) -> DataFrame:
    """EAD (unless given) -> capital -> returns, on top of each other."""
    rp = rp or P.RiskParams()
    st = Stage(df)
    _exposure(st, rp)
    _capital(st, rp)
    _returns(st, rp)
    return st.apply()


def downstream(st: Stage, rp: P.RiskParams) -> Stage:
    """Everything after PD and LGD: returns, minimum price, decisions."""
    _returns(st, rp)
    _minimum_price(st, rp)
    _decisions(st, rp)
    return st


def price_facilities(df: DataFrame, pd_model: str = "logistic", lgd_model: str = "hybrid",
                     rp: P.RiskParams | None = None) -> DataFrame:
    """Full risk-based pricing of every facility row (row count preserved)."""
    rp = rp or P.RiskParams()
    pd.pd_model(pd_model)
    lgd.check_lgd_model(lgd_model)
    st = Stage(df)
    _pd(st, pd_model, rp)
    _lgd(st, lgd_model, rp)
    st.compiled_apart("pd_score", "lgd_score")
    _exposure(st, rp)
    _capital(st, rp)
    return downstream(st, rp).apply()
