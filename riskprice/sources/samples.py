"""Demonstration inputs (used by tests and examples, never by benchmarks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import FACILITY_SCHEMA, PRODUCT_SCHEMA

# FIXED VALUES: the demonstration product list and facility portfolio.
SAMPLE_PRODUCTS = [
    ("P001", "Premium Widget", "premium", 100.0, 150),
    ("P002", "Standard Widget", "standard", 75.0, 75),
    ("P003", "Basic Widget", "basic", 50.0, 25),
    ("P004", "Deluxe Widget", "premium", 120.0, 200),
    ("P005", "Economy Widget", "basic", 30.0, 300),
]

SAMPLE_PORTFOLIO = [
    ("B001", "TechCorp Inc", 750, 0.35, 0.75, 8, 95, "technology", "large",
     "equipment", "senior_secured", "term_loan", 5000000.0, 5000000.0, 0.0, 5, "developed"),
    ("B002", "Manufacturing LLC", 680, 0.45, 0.80, 12, 85, "manufacturing", "medium",
     "real_estate", "senior_secured", "revolving_credit", 2000000.0, 1500000.0, 500000.0, 3, "developed"),
    ("B003", "Retail Chain", 620, 0.55, 0.85, 5, 75, "retail", "large",
     "inventory", "senior_unsecured", "term_loan", 3000000.0, 3000000.0, 0.0, 7, "developed"),
    ("B004", "Healthcare Services", 720, 0.40, 0.70, 10, 90, "healthcare", "medium",
     "equipment", "senior_secured", "revolving_credit", 1500000.0, 1000000.0, 500000.0, 5, "developed"),
    ("B005", "Energy Company", 700, 0.50, 0.75, 15, 80, "energy", "large",
     "real_estate", "senior_secured", "term_loan", 10000000.0, 10000000.0, 0.0, 10, "developed"),
    ("B006", "Small Restaurant", 580, 0.65, 0.90, 3, 65, "hospitality", "small",
     "personal_guarantee", "subordinated", "term_loan", 500000.0, 500000.0, 0.0, 5, "developed"),
    ("B007", "Software Startup", 650, 0.40, 0.60, 2, 70, "technology", "small",
     "unsecured", "senior_unsecured", "revolving_credit", 1000000.0, 250000.0, 750000.0, 3, "developed"),
    ("B008", "Real Estate Developer", 690, 0.60, 0.80, 20, 85, "real_estate", "medium",
     "real_estate", "senior_secured", "term_loan", 8000000.0, 8000000.0, 0.0, 15, "developed"),
]
# end of fixed values


def sample_products(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_PRODUCTS, PRODUCT_SCHEMA)


def sample_portfolio(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_PORTFOLIO, FACILITY_SCHEMA)
