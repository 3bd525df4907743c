"""Rating, recommendation, competitive rate and stress scenario."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from .columns import Ref, ratio_or_null


def risk_rating(ref: Ref = F.col) -> Column:
    """Rating by PD (upper bound inclusive); null PD falls through to CCC."""
    pd_ = ref("pd_score")
    expr = None
    for rating, bound in P.RATING_BANDS:
        cond = pd_ <= F.lit(bound)
        expr = F.when(cond, F.lit(rating)) if expr is None else expr.when(cond, F.lit(rating))
    return expr.otherwise(F.lit(P.RATING_OTHERWISE))


def recommendation_thresholds(rp: P.RiskParams):
    """(label, RAROC threshold) with thresholds computed in double precision."""
    return [(label, rp.target_raroc * mult) for label, mult in P.RECOMMENDATION_BANDS]


def pricing_recommendation(rp: P.RiskParams, ref: Ref = F.col) -> Column:
    r = ref("raroc")
    expr = None
    for label, threshold in recommendation_thresholds(rp):
        cond = r >= F.lit(float(threshold))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(P.RECOMMENDATION_OTHERWISE))


def competitive_rate(rp: P.RiskParams, ref: Ref = F.col) -> Column:
    return ref("minimum_rate") + F.lit(float(rp.competitive_margin))


def stress_expected_loss(rp: P.RiskParams, ref: Ref = F.col) -> Column:
    """Stressed PD x stressed LGD x EAD (the stressed factors are not capped at 1)."""
    return (ref("pd_score") * F.lit(float(rp.stress_pd_factor)) * ref("lgd_score")
            * F.lit(float(rp.stress_lgd_factor)) * ref("ead_amount"))


def stress_minimum_rate(rp: P.RiskParams, ref: Ref = F.col) -> Column:
    return ratio_or_null(
        ref("stress_expected_loss") + ref("funding_cost") + ref("operational_cost")
        + (ref("economic_capital") * F.lit(float(rp.target_roe))),
        ref("ead_amount"))
