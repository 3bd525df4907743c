"""Expected loss, costs, revenue, RAROC and the minimum price."""

from __future__ import annotations

from typing import Dict, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from .columns import Ref, has, ratio_or_null, ratio_or_zero


def loss_and_costs(rp: P.RiskParams, ref: Ref = F.col) -> Dict[str, Column]:
    _ead = lambda: ref("ead_amount")
    return {
        "expected_loss": ref("pd_score") * ref("lgd_score") * _ead(),
        "funding_cost": _ead() * F.lit(float(rp.funding_cost_rate)),
        "operational_cost": _ead() * F.lit(float(rp.operational_cost_rate)),
    }


def revenue(columns: Sequence[str], rp: P.RiskParams, ref: Ref = F.col) -> Dict[str, Column]:
    """Interest at the facility's own rate if given (else the base rate); fees if given."""
    _ead = lambda: ref("ead_amount")
    interest = (_ead() * F.col("interest_rate") if has(columns, "interest_rate")
                else _ead() * F.lit(float(rp.base_interest_rate)))
    fee = _ead() * F.col("fee_rate") if has(columns, "fee_rate") else F.lit(0.0)
    return {"interest_revenue": interest, "fee_revenue": fee}


def total_revenue(ref: Ref = F.col) -> Column:
    return ref("interest_revenue") + ref("fee_revenue")


def net_income(ref: Ref = F.col) -> Column:
    return (ref("total_revenue") - ref("expected_loss")
            - ref("funding_cost") - ref("operational_cost"))


def raroc(ref: Ref = F.col) -> Column:
    """net income / economic capital; 0.0 without capital (e.g. sovereign)."""
    return ratio_or_zero(ref("net_income"), ref("economic_capital"))


def risk_adjusted_margin(ref: Ref = F.col) -> Column:
    return ratio_or_zero(ref("net_income"), ref("ead_amount"))


def required_revenue(rp: P.RiskParams, ref: Ref = F.col) -> Column:
    return (ref("expected_loss") + ref("funding_cost") + ref("operational_cost")
            + (ref("economic_capital") * F.lit(float(rp.target_roe))))


def minimum_rate(ref: Ref = F.col) -> Column:
    return ratio_or_zero(ref("required_revenue"), ref("ead_amount"))


def price_components(rp: P.RiskParams, ref: Ref = F.col) -> Dict[str, Column]:
    """Breakdown of the minimum rate; zero EAD gives NULL components."""
    return {
        "base_rate_component": F.lit(float(rp.funding_cost_rate)),
        "risk_premium_component": ratio_or_null(ref("expected_loss"), ref("ead_amount")),
        "operational_component": F.lit(float(rp.operational_cost_rate)),
        "capital_component": ratio_or_null(
            ref("economic_capital") * F.lit(float(rp.target_roe)), ref("ead_amount")),
    }
