"""End-to-end batch jobs: one pass over the feed per consumer.

``price_and_write`` prices a facility feed, writes the rows and collects the
portfolio totals in the same job through ``DataFrame.observe`` (the metrics are
one row of aggregates, merged from per-task partial results). The distributions
are then computed from the written table, which reads only the two decision
columns and never recomputes the pricing lineage.
"""

from __future__ import annotations

from typing import Dict, Optional, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..params import ProductRules, RiskParams
from ..schemas import ABSENT_OK
from .facilities import price_facilities
from .portfolio import decision_counts, distributions_of, finish_summary, summary_aggregates
from .products import price_products
from .quality import split_facilities, split_products, with_errors


def price_and_write(facilities: DataFrame, out_dir: str, pd_model: str = "logistic",
                    lgd_model: str = "hybrid", rp: Optional[RiskParams] = None,
                    fmt: str = "parquet") -> Dict[str, float]:
    """Write priced rows to ``out_dir``; return the portfolio totals of the same run.

    The metrics are observed in the write job's result stage, whose task updates
    Spark applies once per partition even when tasks are retried."""
    priced = price_facilities(facilities, pd_model, lgd_model, rp)
    obs = Observation("portfolio")
    observed = priced.observe(obs, *summary_aggregates())
    observed.write.mode("overwrite").format(fmt).save(out_dir)
    return finish_summary(obs.get)


def price_checked(feed: DataFrame, out_dir: str, pd_model: str = "logistic", lgd_model: str = "hybrid",
                  rp: Optional[RiskParams] = None) -> Dict[str, float]:
    """Check, then price: valid rows are priced to ``out_dir``/rows, the others go to
    ``out_dir``/rejected with their ``validation_errors``. Returns the portfolio totals of the
    valid rows and the number of rejected ones; accepted + rejected = input."""
    valid, rejected = split_facilities(feed, ABSENT_OK)
    totals = price_and_write(valid, out_dir + "/rows", pd_model, lgd_model, rp)
    return {**totals, "rejected_count": _write_counted(rejected, out_dir + "/rejected")}


def price_products_checked(feed: DataFrame, out_dir: str, rules: Optional[ProductRules] = None) -> int:
    """The same for products; returns the number of rejected rows."""
    valid, rejected = split_products(feed)
    price_products(valid, rules).write.mode("overwrite").parquet(out_dir + "/rows")
    return _write_counted(rejected, out_dir + "/rejected")


def _write_counted(df: DataFrame, path: str) -> int:
    obs = Observation("written")
    df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return int(obs.get["n"])


def written_distributions(spark: SparkSession, out_dir: str, fmt: str = "parquet") -> DataFrame:
    """(dimension, value, count) for rating and recommendation from the written rows."""
    rows = spark.read.format(fmt).load(out_dir).select("risk_rating", "pricing_recommendation")
    return distributions_of(decision_counts(rows))


def split_and_write(feed: DataFrame, rules, out_dir: str, fmt: str = "parquet",
                    absent_ok: Sequence[str] = ()) -> None:
    """Quarantine split in one pass: every row is checked once and written under
    ``accepted=true`` or ``accepted=false`` (rejected rows keep ``validation_errors``),
    instead of two filters that would each scan the feed."""
    checked = with_errors(feed, rules, absent_ok).withColumn(
        "accepted", F.col("validation_errors") == F.lit(""))
    checked.write.mode("overwrite").format(fmt).partitionBy("accepted").save(out_dir)


def read_split(spark: SparkSession, out_dir: str, accepted: bool, fmt: str = "parquet") -> DataFrame:
    """One side of a written split (partition pruning reads only that side)."""
    side = spark.read.format(fmt).load(out_dir).filter(F.col("accepted") == F.lit(accepted))
    side = side.drop("accepted")
    return side.drop("validation_errors") if accepted else side
