"""Probability-of-default models (column factories + registry)."""

from __future__ import annotations

from typing import Callable, Dict, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from . import registry
from .columns import clip_when, factor, first_band, has, lookup


def logistic_score(columns: Sequence[str], model: P.LogisticModel) -> Column:
    """Linear score z = intercept + sum(coef * feature) over features present."""
    z = F.lit(float(model.intercept))
    for feature, coef in model.coefficients.items():
        if feature in columns:
            z = z + F.col(feature) * F.lit(float(coef))
    return z


def logistic_link(columns: Sequence[str], rp: P.RiskParams) -> Column:
    """1 / (1 + exp(-z))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logistic_score(columns, rp.logistic)))


def clip_pd(raw: Column) -> Column:
    """Capped at 0.99 and floored at 0.001."""
    return clip_when(raw, P.PD_FLOOR, P.PD_CAP)


def logistic_pd(columns: Sequence[str], rp: P.RiskParams) -> Column:
    """The logistic PD as one expression."""
    return clip_pd(logistic_link(columns, rp))


def score_bucket_pd(columns: Sequence[str] = (), rp: P.RiskParams | None = None) -> Column:
    """PD by credit-score bucket (lower bound inclusive)."""
    return first_band("credit_score", P.SCORE_PD_BUCKETS, ">=", P.SCORE_PD_OTHERWISE)


def dti_uplift(columns: Sequence[str]) -> Column:
    if not has(columns, "debt_to_income"):
        return F.lit(1.0)
    return first_band("debt_to_income", P.DTI_PD_UPLIFT, ">", 1.0)


def score_based_pd(columns: Sequence[str], rp: P.RiskParams) -> Column:
    """Bucket PD times the debt-to-income uplift (no clip)."""
    base = score_bucket_pd(columns, rp)
    if not has(columns, "debt_to_income"):
        return base
    return base * dti_uplift(columns)


def industry_base_pd(columns: Sequence[str] = (), rp: P.RiskParams | None = None) -> Column:
    return lookup("industry", P.INDUSTRY_PD, P.INDUSTRY_PD_DEFAULT)


def industry_pd(columns: Sequence[str], rp: P.RiskParams) -> Column:
    """Sector PD times the company-size multiplier (no clip)."""
    base = industry_base_pd(columns, rp)
    if not has(columns, "company_size"):
        return base
    return base * factor("company_size", P.SIZE_PD_MULTIPLIER)


PD_MODELS: Dict[str, Callable[[Sequence[str], P.RiskParams], Column]] = {
    "logistic": logistic_pd,
    "score_based": score_based_pd,
    "industry": industry_pd,
}


def pd_model(name: str) -> Callable[[Sequence[str], P.RiskParams], Column]:
    registry.PD.check(name)
    return PD_MODELS[name] if name in PD_MODELS else registry.PD.own[name].build


def unclipped_pd(name: str) -> Callable[[Sequence[str], P.RiskParams], Column] | None:
    """What a model's clip is applied to; None for a model without one."""
    return logistic_link if name == "logistic" else None
