"""Catalogue of the available models, risk types and economic conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import params as P
from ..functions import registry


def model_catalog(spark: SparkSession) -> DataFrame:
    rows = [("pd_model", k, v) for k, v in P.PD_MODEL_DESCRIPTIONS.items()]
    rows += [("pd_model", m.name, m.description) for m in registry.PD.own.values()]
    rows += [("lgd_model", k, v) for k, v in P.LGD_MODEL_DESCRIPTIONS.items()]
    rows += [("lgd_model", m.name, m.description) for m in registry.LGD.own.values()]
    rows += [("risk_type", k, f"regulatory capital rate {P.REGULATORY_CAPITAL_RATE[k]}")
             for k in P.RISK_TYPES]
    rows += [("economic_condition", k, f"collateral LGD factor {P.ECONOMIC_CONDITION_LGD[k]}")
             for k in P.ECONOMIC_CONDITIONS]
    return spark.createDataFrame(rows, "kind string, name string, description string")
