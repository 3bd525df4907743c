"""Facility and product-line feeds derived from the TPC-H style test tables.

One order is one facility, one line item is one product line. All attributes are
deterministic integer arithmetic on keys and columns, so Spark and any SQL engine
derive identical rows. The joins are plain equi-joins without hints, size checks or
caches: building a feed runs no job, the planner and AQE choose the join from the
tables' real bytes at every size, and a customer or part that holds a large share of
the rows is split by AQE's skew join.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import map_lookup, sql_literal

# FIXED VALUES of the fixture derivation (same lists as the SQL oracle).
INDUSTRY_BY_ORDER = ("technology", "healthcare", "financial_services", "manufacturing",
                     "retail", "energy", "real_estate", "hospitality", "transportation",
                     "services", "agriculture", "mining")
COLLATERAL_BY_CUSTOMER = ("real_estate", "equipment", "inventory", "accounts_receivable",
                          "cash_securities", "personal_guarantee", "unsecured", "other")
FACILITY_TYPE_BY_KEYS = ("term_loan", "revolving_credit", "letter_of_credit", "guarantee",
                         "commitment", "overdraft")
SENIORITY_BY_PRIORITY = (("1-URGENT", "senior_secured"), ("2-HIGH", "senior_secured"),
                         ("3-MEDIUM", "senior_unsecured"), ("5-LOW", "subordinated"))
SENIORITY_OTHER = "mezzanine"
SIZE_BY_BALANCE = ((6000, "large"), (2000, "medium"), (0, "small"))
SIZE_OTHER = "micro"
REGION_CLASS = (("EUROPE", "developed"), ("AMERICA", "developed"), ("MIDDLE EAST", "frontier"))
REGION_OTHER = "emerging"
DRAWN_SHARE = (("F", 1.0, 0.0), ("P", 0.5, 0.5))     # status, outstanding, undrawn
DRAWN_OTHER = (0.25, 0.75)
PREMIUM_TYPES = ("PROMO", "LARGE")
STANDARD_TYPES = ("STANDARD", "MEDIUM")
# Rows spoiled on purpose for the quarantine feeds (key divisor, bad value).
SPOIL_CREDIT_SCORE = (97, 1000)
SPOIL_DEBT_TO_INCOME = (89, -0.5)
SPOIL_QUANTITY = (97, 0)
SPOIL_CATEGORY = 89
# end of fixed values


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index_sql: str, values: Sequence[str]) -> Column:
    """values[index]; any other index gives the last value."""
    return map_lookup(index_sql, dict(enumerate(values[:-1])), values[-1])


def _match(key_sql: str, pairs, otherwise) -> Column:
    return map_lookup(key_sql, dict(pairs), otherwise)


def _ratio100(x: Column) -> Column:
    return x.cast("double") / F.lit(100).cast("double")


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
CUSTOMER_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal")
LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_quantity")
PART_COLUMNS = ("p_partkey", "p_name", "p_type", "p_retailprice")


def region_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return geo.select("n_nationkey",
                      _match("r_name", REGION_CLASS, REGION_OTHER).alias("region"))


def facilities(spark: SparkSession, sf_dir: str, spoiled: bool = False) -> DataFrame:
    """The facility feed (FACILITY_SCHEMA column order).

    ``spoiled`` replaces a few values by out-of-domain ones, for the quarantine split."""
    orders = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    customer = table(spark, sf_dir, "customer").select(*CUSTOMER_COLUMNS)
    return facilities_of(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), region_dimension(spark, sf_dir), spoiled)


def facilities_of(orders_with_customer: DataFrame, regions: DataFrame, spoiled: bool = False) -> DataFrame:
    """The facility feed from orders that are joined with their customers."""
    j = orders_with_customer.join(regions, F.col("c_nationkey") == F.col("n_nationkey"))
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    credit = (F.lit(300) + (ok * F.lit(7919) + ck * F.lit(104729)) % F.lit(551)).cast("int")
    dti = _ratio100((ok * F.lit(31) + F.lit(7)) % F.lit(201))
    if spoiled:
        div, bad = SPOIL_CREDIT_SCORE
        credit = F.when(ok % F.lit(div) == F.lit(0), F.lit(bad)).otherwise(credit)
        div, bad = SPOIL_DEBT_TO_INCOME
        dti = F.when(ok % F.lit(div) == F.lit(0), F.lit(bad)).otherwise(dti)
    price = F.col("o_totalprice")
    out_share = _match("o_orderstatus", [(s, float(o)) for s, o, _ in DRAWN_SHARE], float(DRAWN_OTHER[0]))
    und_share = _match("o_orderstatus", [(s, float(u)) for s, _, u in DRAWN_SHARE], float(DRAWN_OTHER[1]))
    size = F.expr("CASE " + " ".join(f"WHEN c_acctbal >= {b} THEN {sql_literal(l)}"
                                     for b, l in SIZE_BY_BALANCE)
                  + f" ELSE {sql_literal(SIZE_OTHER)} END")
    return j.select(
        ok.cast("string").alias("borrower_id"),
        F.col("c_name").alias("borrower_name"),
        credit.alias("credit_score"),
        dti.alias("debt_to_income"),
        _ratio100((ok * F.lit(17) + ck) % F.lit(151)).alias("loan_to_value"),
        (ck % F.lit(21)).cast("int").alias("employment_years"),
        ((ok * F.lit(3) + ck) % F.lit(101)).cast("int").alias("payment_history_score"),
        _pick("o_orderkey % 12", INDUSTRY_BY_ORDER).alias("industry"),
        size.alias("company_size"),
        _pick("o_custkey % 8", COLLATERAL_BY_CUSTOMER).alias("collateral_type"),
        _match("o_orderpriority", SENIORITY_BY_PRIORITY, SENIORITY_OTHER).alias("seniority"),
        _pick("(o_orderkey + o_custkey) % 6", FACILITY_TYPE_BY_KEYS).alias("facility_type"),
        price.alias("exposure_amount"),
        (price * out_share).alias("outstanding_amount"),
        (price * und_share).alias("undrawn_amount"),
        (F.lit(1) + ok % F.lit(15)).cast("int").alias("loan_term"),
        F.col("region"),
    )


def facilities_with_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility feed carrying its own interest_rate and fee_rate (optional inputs)."""
    f = facilities(spark, sf_dir)
    key = F.col("borrower_id").cast("bigint")
    return f.withColumns({
        "interest_rate": _ratio100(F.lit(300) + key % F.lit(701)) / F.lit(100).cast("double"),
        "fee_rate": _ratio100(key % F.lit(51)) / F.lit(100).cast("double"),
    })


def product_lines(spark: SparkSession, sf_dir: str, spoiled: bool = False) -> DataFrame:
    """The product feed (PRODUCT_SCHEMA column order): one row per line item."""
    li = table(spark, sf_dir, "lineitem").select(*LINE_COLUMNS)
    part = table(spark, sf_dir, "part").select(*PART_COLUMNS)
    return product_lines_of(li.join(part, F.col("l_partkey") == F.col("p_partkey")), spoiled)


def product_lines_of(j: DataFrame, spoiled: bool = False) -> DataFrame:
    """The product feed from line items that are joined with their parts."""
    t = F.col("p_type")
    category = (F.when(t.isin(*PREMIUM_TYPES), F.lit("premium"))
                 .when(t.isin(*STANDARD_TYPES), F.lit("standard"))
                 .otherwise(F.lit("basic")))
    quantity = F.col("l_quantity").cast("int")
    if spoiled:
        ok = F.col("l_orderkey")
        div, bad = SPOIL_QUANTITY
        quantity = F.when(ok % F.lit(div) == F.lit(0), F.lit(bad)).otherwise(quantity)
        category = F.when(ok % F.lit(SPOIL_CATEGORY) == F.lit(0), F.lit(None).cast("string")) \
                    .otherwise(category)
    return j.select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("name"),
        category.alias("category"),
        F.col("p_retailprice").alias("cost"),
        quantity.alias("quantity"),
    )
