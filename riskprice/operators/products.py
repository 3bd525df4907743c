"""Product pricing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import product
from ..params import ProductRules


def add_base_price(df: DataFrame, rules: ProductRules | None = None) -> DataFrame:
    return df.withColumns({"base_price": product.base_price(rules or ProductRules())})


def add_discount(df: DataFrame, rules: ProductRules | None = None) -> DataFrame:
    out = df.withColumns({"discount_rate": product.discount_rate(rules or ProductRules())})
    return out.withColumns({"final_price": product.final_price()})


def price_products(df: DataFrame, rules: ProductRules | None = None) -> DataFrame:
    """base_price, discount_rate, final_price appended to every product row."""
    rules = rules or ProductRules()
    return df.transform(add_base_price, rules).transform(add_discount, rules)
