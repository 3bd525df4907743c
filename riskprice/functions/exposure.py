"""Exposure at default and capital."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from .columns import Ref, has, lookup


def ccf() -> Column:
    return lookup("facility_type", P.CCF, P.CCF_DEFAULT)


def ead(columns: Sequence[str], rp: P.RiskParams, ref: Ref = F.col) -> Column:
    """outstanding + undrawn * CCF when both amounts exist, else exposure * CCF; times stress."""
    c = ref("ccf")
    if has(columns, "outstanding_amount", "undrawn_amount"):
        base = F.col("outstanding_amount") + (F.col("undrawn_amount") * c)
    else:
        base = F.col("exposure_amount") * c
    return base * F.lit(float(rp.stress_factor))


def regulatory_capital(rp: P.RiskParams, ref: Ref = F.col) -> Column:
    return ref("ead_amount") * F.lit(float(rp.regulatory_capital_rate))


def economic_capital(rp: P.RiskParams, ref: Ref = F.col) -> Column:
    return ref("regulatory_capital") * F.lit(float(rp.economic_capital_multiplier))
