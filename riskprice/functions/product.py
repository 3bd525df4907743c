"""Product pricing: category mark-up and volume discount."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import ProductRules


def base_price(rules: ProductRules) -> Column:
    """cost x category multiplier; any category other than premium/standard is basic."""
    cat, cost = F.col("category"), F.col("cost")
    return (F.when(cat == F.lit("premium"), cost * F.lit(float(rules.premium_multiplier)))
            .when(cat == F.lit("standard"), cost * F.lit(float(rules.standard_multiplier)))
            .otherwise(cost * F.lit(float(rules.basic_multiplier))))


def discount_rate(rules: ProductRules) -> Column:
    """Bulk tier is tested first; thresholds are inclusive; null quantity -> 0."""
    q = F.col("quantity")
    return (F.when(q >= F.lit(rules.bulk_threshold), F.lit(float(rules.bulk_discount)))
            .when(q >= F.lit(rules.medium_threshold), F.lit(float(rules.medium_discount)))
            .otherwise(F.lit(0.0)))


def final_price() -> Column:
    """Unit price after discount (quantity is not multiplied in)."""
    return F.col("base_price") * (F.lit(1.0) - F.col("discount_rate"))
