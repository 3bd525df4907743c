"""Loss-given-default models (column factories + registry)."""

from __future__ import annotations

from typing import Dict, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from . import registry
from .columns import Ref, cap_then_floor, factor, first_band, floor_then_cap, has, lookup


def collateral_base(columns: Sequence[str] = ()) -> Column:
    return lookup("collateral_type", P.COLLATERAL_LGD, P.COLLATERAL_LGD_DEFAULT)


def ltv_adjustment(columns: Sequence[str]) -> Column:
    """LTV band (upper bound inclusive); null LTV -> top band; no column -> 1.0."""
    if not has(columns, "loan_to_value"):
        return F.lit(1.0)
    return first_band("loan_to_value", P.LTV_LGD_BANDS, "<=", P.LTV_LGD_OTHERWISE)


def seniority_adjustment(columns: Sequence[str]) -> Column:
    if not has(columns, "seniority"):
        return F.lit(1.0)
    return lookup("seniority", P.SENIORITY_LGD, P.SENIORITY_LGD_DEFAULT)


def collateral_parts(columns: Sequence[str]) -> Dict[str, Column]:
    """The three visible inputs of the collateral model, in output order."""
    return {
        "base_lgd": collateral_base(columns),
        "ltv_adjustment": ltv_adjustment(columns),
        "seniority_adjustment": seniority_adjustment(columns),
    }


def collateral_lgd(rp: P.RiskParams, ref: Ref = F.col) -> Column:
    """base * ltv * seniority * economic factor, capped at 0.95 then floored at 0.05."""
    raw = (ref("base_lgd") * ref("ltv_adjustment") * ref("seniority_adjustment")
           * F.lit(float(rp.economic_adjustment)))
    return cap_then_floor(raw, P.LGD_FLOOR, P.LGD_CAP)


def industry_base(columns: Sequence[str] = ()) -> Column:
    return lookup("industry", P.INDUSTRY_LGD, P.INDUSTRY_LGD_DEFAULT)


def industry_lgd(columns: Sequence[str]) -> Column:
    """Sector LGD x size x region multipliers, floored at 0.05 then capped at 0.95."""
    x = industry_base(columns)
    if has(columns, "company_size"):
        x = x * factor("company_size", P.SIZE_LGD_MULTIPLIER)
    if has(columns, "region"):
        x = x * factor("region", P.REGION_LGD_MULTIPLIER)
    return floor_then_cap(x, P.LGD_FLOOR, P.LGD_CAP)


def term_uplift(columns: Sequence[str]) -> Column:
    if not has(columns, "loan_term"):
        return F.lit(1.0)
    return first_band("loan_term", P.TERM_LGD_UPLIFT, ">", 1.0)


def hybrid_blend(collateral: Column, industry: Column) -> Column:
    """Row-local weighted blend of the two (already clipped) model LGDs."""
    return (collateral * F.lit(P.HYBRID_COLLATERAL_WEIGHT)) + (industry * F.lit(P.HYBRID_INDUSTRY_WEIGHT))


def hybrid_lgd(columns: Sequence[str], collateral: Column, industry: Column) -> Column:
    x = hybrid_blend(collateral, industry)
    if has(columns, "loan_term"):
        x = x * term_uplift(columns)
    return floor_then_cap(x, P.LGD_FLOOR, P.LGD_CAP)


LGD_MODELS = ("collateral", "industry", "hybrid")


def check_lgd_model(name: str) -> str:
    return registry.LGD.check(name)
