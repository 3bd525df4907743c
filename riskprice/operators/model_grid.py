"""All PD x LGD model pairs in one scan: the nine built-in ones, and those of registered
models.

Per facility, the three PD models, the three LGD models, EAD and capital are
computed once; the row is then replicated into its nine (pd, lgd) pairs with a
static ``explode`` (a generator inside the same stage, no join) and the shared
return/decision steps run on the replicated rows. Summaries group by the pair
key: partial aggregation happens before the shuffle, so at most
9 x #partitions rows are exchanged whatever the input size.
"""

from __future__ import annotations

from typing import Tuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import lgd, pd, registry
from . import facilities, portfolio

PD_MODEL_NAMES = tuple(pd.PD_MODELS)
LGD_MODEL_NAMES = lgd.LGD_MODELS
MODEL_PAIRS: Tuple[Tuple[str, str], ...] = tuple(
    (p, l) for p in PD_MODEL_NAMES for l in LGD_MODEL_NAMES)

GRID_ROW_COLUMNS = ("model_key", "pd_model", "lgd_model", "borrower_id", "pd_score",
                    "lgd_score", "ead_amount", "economic_capital", "expected_loss",
                    "net_income", "raroc", "minimum_rate", "risk_rating",
                    "pricing_recommendation")


def model_pairs() -> Tuple[Tuple[str, str], ...]:
    """The pairs of all models known now, built-in and registered."""
    return tuple((p, l) for p in registry.PD.names() for l in registry.LGD.names())


def _model_columns(df: DataFrame, rp: P.RiskParams) -> DataFrame:
    """The PDs and LGDs of all models, EAD and capital of each facility."""
    cols = df.columns
    st = facilities.Stage(df)
    for name in registry.PD.names():
        facilities.put_pd(st, f"_pd_{name}", name, rp)
    for name, model in registry.LGD.own.items():
        st.put(f"_lgd_{name}", model.build(cols, rp))
    parts = lgd.collateral_parts(cols)
    st.put("_lgd_collateral", lgd.collateral_lgd(rp, lambda n: parts[n]))
    st.put("_lgd_industry", lgd.industry_lgd(cols)).next()
    st.put("_lgd_hybrid", lgd.hybrid_lgd(cols, st.ref("_lgd_collateral"), st.ref("_lgd_industry")))
    facilities._exposure(st, rp)
    facilities._capital(st, rp)
    return st.apply()


def model_grid_rows(df: DataFrame, rp: P.RiskParams | None = None,
                    keep: Tuple[str, ...] = ()) -> DataFrame:
    """One priced row per (facility, model pair): N rows in, 9N rows out."""
    rp = rp or P.RiskParams()
    base = _model_columns(df, rp)
    pairs = F.array(*[
        F.struct(F.lit(f"{p}_{l}").alias("model_key"), F.lit(p).alias("pd_model"),
                 F.lit(l).alias("lgd_model"), F.col(f"_pd_{p}").alias("pd_score"),
                 F.col(f"_lgd_{l}").alias("lgd_score"))
        for p, l in model_pairs()])
    carry = [c for c in df.columns if c not in ("pd_score", "lgd_score")]
    carry += [c for c in ("ccf", "ead_amount", "regulatory_capital", "economic_capital")
              if c not in carry and c in base.columns]
    exploded = base.select(*carry, F.explode(pairs).alias("_pair")).select(
        "_pair.model_key", "_pair.pd_model", "_pair.lgd_model", *carry,
        "_pair.pd_score", "_pair.lgd_score")
    priced = facilities.downstream(facilities.Stage(exploded), rp).apply()
    return priced.select(*GRID_ROW_COLUMNS, *keep)


def model_grid(df: DataFrame, rp: P.RiskParams | None = None) -> DataFrame:
    """Nine rows, one per model pair, with the full portfolio summary of each."""
    rows = model_grid_rows(df, rp)
    return portfolio.grouped_summary(rows, "model_key", "pd_model", "lgd_model")


def model_grid_distribution(df: DataFrame, rp: P.RiskParams | None = None) -> DataFrame:
    """Rating and recommendation counts per pair, (model_key, dimension, value, count): one
    aggregation over the priced rows, whose few groups are then unpivoted."""
    rows = model_grid_rows(df, rp)
    return portfolio.distributions_of(portfolio.decision_counts(rows, "model_key"), "model_key")
