"""Job parameters and rate cards.

Every pricing step reads its constants from the frozen dataclasses below, so a
job's behaviour is fully described by one ``ProductRules`` or ``RiskParams``
value that is validated once, on the driver, before any plan is built.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Mapping


def _frozen(d: dict) -> Mapping:
    return MappingProxyType(dict(d))


# ---------------------------------------------------------------------------
# FIXED VALUES. These rate cards, bands and defaults must equal the model
# specification exactly (results depend on every digit). Listed in natural
# order; lookups are exact and case-sensitive, and a key that is absent
# (or null) falls back to the stated default.
# ---------------------------------------------------------------------------

# Logistic PD: intercept and one coefficient per feature column.
LOGISTIC_INTERCEPT = -2.5
LOGISTIC_COEFFICIENTS = _frozen({
    "credit_score": -0.008,
    "debt_to_income": 1.2,
    "loan_to_value": 0.5,
    "employment_years": -0.1,
    "payment_history_score": -0.02,
})
PD_FLOOR = 0.001
PD_CAP = 0.99

# Score-based PD: (lowest credit score of the bucket, PD), best bucket first.
SCORE_PD_BUCKETS = ((800, 0.002), (750, 0.005), (700, 0.015), (650, 0.035),
                    (600, 0.075), (550, 0.150))
SCORE_PD_OTHERWISE = 0.250
# Debt-to-income uplift: (DTI strictly above, PD multiplier).
DTI_PD_UPLIFT = ((0.5, 1.5), (0.4, 1.2))

# Industry PD.
INDUSTRY_PD = _frozen({
    "technology": 0.015,
    "healthcare": 0.020,
    "financial_services": 0.025,
    "manufacturing": 0.035,
    "retail": 0.045,
    "energy": 0.055,
    "real_estate": 0.065,
    "hospitality": 0.080,
})
INDUSTRY_PD_DEFAULT = 0.040
SIZE_PD_MULTIPLIER = _frozen({"large": 0.8, "medium": 0.9, "small": 1.2})

# Collateral LGD.
COLLATERAL_LGD = _frozen({
    "real_estate": 0.25,
    "equipment": 0.45,
    "inventory": 0.65,
    "accounts_receivable": 0.55,
    "cash_securities": 0.05,
    "personal_guarantee": 0.75,
    "unsecured": 0.85,
})
COLLATERAL_LGD_DEFAULT = 0.70
# Loan-to-value bands: (LTV at most, adjustment); above the last band 1.4.
LTV_LGD_BANDS = ((0.5, 0.8), (0.7, 0.9), (0.8, 1.0), (0.9, 1.2))
LTV_LGD_OTHERWISE = 1.4
SENIORITY_LGD = _frozen({"senior_secured": 0.8, "senior_unsecured": 1.0,
                         "subordinated": 1.3})
SENIORITY_LGD_DEFAULT = 1.0
ECONOMIC_CONDITION_LGD = _frozen({"recession": 1.3, "normal": 1.0, "expansion": 0.9})
ECONOMIC_CONDITION_DEFAULT = 1.0

# Industry LGD.
INDUSTRY_LGD = _frozen({
    "real_estate": 0.30,
    "manufacturing": 0.40,
    "energy": 0.35,
    "transportation": 0.45,
    "technology": 0.70,
    "services": 0.75,
    "healthcare": 0.50,
    "retail": 0.60,
    "financial_services": 0.65,
    "hospitality": 0.55,
})
INDUSTRY_LGD_DEFAULT = 0.60
SIZE_LGD_MULTIPLIER = _frozen({"large": 0.85, "medium": 0.95, "small": 1.1})
REGION_LGD_MULTIPLIER = _frozen({"developed": 0.9, "emerging": 1.2})

# Hybrid LGD: blend weights and loan-term uplift (term strictly above, factor).
HYBRID_COLLATERAL_WEIGHT = 0.6
HYBRID_INDUSTRY_WEIGHT = 0.4
TERM_LGD_UPLIFT = ((5, 1.1), (3, 1.05))
LGD_FLOOR = 0.05
LGD_CAP = 0.95

# Credit conversion factors by facility type.
CCF = _frozen({
    "term_loan": 1.0,
    "revolving_credit": 0.75,
    "letter_of_credit": 0.5,
    "guarantee": 1.0,
    "commitment": 0.3,
})
CCF_DEFAULT = 0.75

# Regulatory capital rate by risk type; economic capital multiplier.
REGULATORY_CAPITAL_RATE = _frozen({
    "corporate": 0.08,
    "sme": 0.075,
    "retail": 0.035,
    "sovereign": 0.0,
    "bank": 0.02,
})
REGULATORY_CAPITAL_DEFAULT = 0.08
ECONOMIC_CAPITAL_MULTIPLIER = 1.5

# Cost and revenue rates.
FUNDING_COST_RATE = 0.025
OPERATIONAL_COST_RATE = 0.005
TARGET_ROE = 0.15
BASE_INTEREST_RATE = 0.06

# Risk rating: (PD at most, rating); above the last band CCC.
RATING_BANDS = (("AAA", 0.01), ("AA", 0.02), ("A", 0.05), ("BBB", 0.10),
                ("BB", 0.20), ("B", 0.30))
RATING_OTHERWISE = "CCC"
# Pricing recommendation: (label, multiple of target RAROC to reach).
RECOMMENDATION_BANDS = (("HIGHLY_ATTRACTIVE", 1.5), ("ATTRACTIVE", 1.0),
                        ("ACCEPTABLE", 0.8), ("MARGINAL", 0.5))
RECOMMENDATION_OTHERWISE = "REJECT"

RISK_TYPES = ("corporate", "sme", "retail", "sovereign", "bank")
ECONOMIC_CONDITIONS = ("recession", "normal", "expansion")
# --------------------------------------------------------------------------- end of fixed values

# What each model does, for the catalogue.
PD_MODEL_DESCRIPTIONS = _frozen({
    "logistic": "sigmoid of a weighted sum of borrower features, kept between 0.1 % and 99 %",
    "score_based": "default rate of the credit-score band, raised for indebted borrowers",
    "industry": "sector default rate, scaled by the size of the company",
})
LGD_MODEL_DESCRIPTIONS = _frozen({
    "collateral": "loss on the pledged asset class, adjusted for loan-to-value, seniority and economy",
    "industry": "sector loss rate, scaled by company size and region",
    "hybrid": "weighted mean of the collateral and industry rates, raised for long terms",
})


@dataclass(frozen=True)
class ProductRules:
    """Category multipliers and volume-discount tiers for product pricing."""

    premium_multiplier: float = 2.0
    standard_multiplier: float = 1.5
    basic_multiplier: float = 1.2
    bulk_threshold: int = 100
    bulk_discount: float = 0.1
    medium_threshold: int = 50
    medium_discount: float = 0.05

    def __post_init__(self) -> None:
        for name in ("premium_multiplier", "standard_multiplier", "basic_multiplier",
                     "bulk_threshold", "medium_threshold"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be > 0, got {getattr(self, name)!r}")
        for name in ("bulk_discount", "medium_discount"):
            v = getattr(self, name)
            if not 0 <= v <= 1:
                raise ValueError(f"{name} must be within 0..1, got {v!r}")

    @classmethod
    def from_dict(cls, d: Mapping | None) -> "ProductRules":
        """Missing block or missing keys -> defaults; unknown keys are ignored."""
        d = dict(d or {})
        known = {k: d[k] for k in cls.__dataclass_fields__ if k in d and d[k] is not None}
        return cls(**known)


@dataclass(frozen=True)
class LogisticModel:
    """Logistic PD coefficients; a custom model replaces the whole set."""

    intercept: float = LOGISTIC_INTERCEPT
    coefficients: Mapping[str, float] = field(default_factory=lambda: LOGISTIC_COEFFICIENTS)

    @classmethod
    def from_dict(cls, d: Mapping[str, float] | None) -> "LogisticModel":
        if not d:
            return cls()
        d = dict(d)
        if "intercept" not in d:
            raise ValueError("custom logistic coefficients need an 'intercept'")
        intercept = d.pop("intercept")
        return cls(intercept=float(intercept), coefficients=_frozen(d))


@dataclass(frozen=True)
class RiskParams:
    """Parameters of one facility-pricing run (defaults = the standard run)."""

    risk_type: str = "corporate"
    target_raroc: float = 0.15
    competitive_margin: float = 0.02
    stress_pd_factor: float = 2.0
    stress_lgd_factor: float = 1.3
    economic_condition: str = "normal"
    stress_factor: float = 1.0
    target_roe: float = TARGET_ROE
    funding_cost_rate: float = FUNDING_COST_RATE
    operational_cost_rate: float = OPERATIONAL_COST_RATE
    base_interest_rate: float = BASE_INTEREST_RATE
    economic_capital_multiplier: float = ECONOMIC_CAPITAL_MULTIPLIER
    logistic: LogisticModel = field(default_factory=LogisticModel)

    def __post_init__(self) -> None:
        if not self.target_raroc > 0:
            raise ValueError(f"target_raroc must be > 0, got {self.target_raroc!r}")
        if not self.competitive_margin >= 0:
            raise ValueError(f"competitive_margin must be >= 0, got {self.competitive_margin!r}")
        for name in ("stress_pd_factor", "stress_lgd_factor"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be > 0, got {getattr(self, name)!r}")
        for name in ("risk_type", "economic_condition"):
            if not isinstance(getattr(self, name), str):
                raise ValueError(f"{name} must be a string")

    @property
    def regulatory_capital_rate(self) -> float:
        return REGULATORY_CAPITAL_RATE.get(self.risk_type, REGULATORY_CAPITAL_DEFAULT)

    @property
    def economic_adjustment(self) -> float:
        return ECONOMIC_CONDITION_LGD.get(self.economic_condition, ECONOMIC_CONDITION_DEFAULT)

    @classmethod
    def from_dict(cls, d: Mapping | None) -> "RiskParams":
        d = dict(d or {})
        kw = {k: d[k] for k in cls.__dataclass_fields__
              if k in d and k != "logistic" and d[k] is not None}
        if d.get("coefficients") is not None:
            kw["logistic"] = LogisticModel.from_dict(d["coefficients"])
        return cls(**kw)
