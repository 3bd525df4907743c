"""riskprice - risk-based pricing of loan facilities and product lines on Spark.

Every formula is a built-in Spark column expression; operators are
``DataFrame -> DataFrame`` functions that compose into one lazy plan.
"""

from .params import LogisticModel, ProductRules, RiskParams
from .functions.registry import own_models, register_lgd_model, register_pd_model, unregister_lgd_model, unregister_pd_model
from .operators.facilities import (add_capital, add_decisions, add_exposure, add_lgd,
                                   add_minimum_price, add_pd, add_raroc, add_returns,
                                   price_facilities)
from .operators.products import add_base_price, add_discount, price_products
from .operators.portfolio import (grouped_summary, portfolio_summary, product_summary,
                                  recommendation_distribution, risk_distribution)
from .operators.model_grid import MODEL_PAIRS, model_grid, model_grid_distribution, model_grid_rows, model_pairs
from .operators.quality import split_facilities, split_products
from .operators.jobs import price_and_write, split_and_write, written_distributions
from .operators.publish import publish_facilities, publish_products, read_published

__all__ = [
    "LogisticModel", "ProductRules", "RiskParams",
    "add_pd", "add_lgd", "add_exposure", "add_capital", "add_returns", "add_raroc",
    "add_minimum_price", "add_decisions", "price_facilities",
    "add_base_price", "add_discount", "price_products",
    "portfolio_summary", "grouped_summary", "product_summary", "risk_distribution",
    "recommendation_distribution", "MODEL_PAIRS", "model_grid", "model_grid_rows",
    "model_grid_distribution", "split_facilities", "split_products",
    "price_and_write", "split_and_write", "written_distributions", "publish_facilities", "publish_products", "read_published",
    "own_models", "register_pd_model", "register_lgd_model", "unregister_pd_model", "unregister_lgd_model", "model_pairs",
]
