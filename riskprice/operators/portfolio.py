"""Portfolio and product summaries.

Summaries stay DataFrames (one row, or one row per group) so the caller decides
where they go; each is one aggregation job whose partial aggregates are combined
map-side before a shuffle of at most (#partitions x #groups) rows.
"""

from __future__ import annotations

from typing import List, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SUMS = (("total_exposure", "ead_amount"), ("total_expected_loss", "expected_loss"),
         ("total_economic_capital", "economic_capital"), ("total_net_income", "net_income"))
_AVGS = (("average_pd", "pd_score"), ("average_lgd", "lgd_score"),
         ("average_individual_raroc", "raroc"), ("average_minimum_rate", "minimum_rate"))

SUMMARY_COLUMNS = ("total_exposure", "total_expected_loss", "total_economic_capital",
                   "total_net_income", "portfolio_raroc", "average_pd", "average_lgd",
                   "average_individual_raroc", "average_minimum_rate", "expected_loss_rate",
                   "facility_count")


# Sums are exact: each value counts in whole units of 1e-6 (money) or 1e-12 (rates), held as
# limbs that are summed apart: value = high * 2^44 + middle * 2^22 + low, high a double that
# holds a whole number, the others longs under 2^22. Sums of 2^41 rows fit the longs, and the
# high sum is a whole number below 2^53 as long as a total is under 2^97 units (1.6e23 of
# money), so totals depend neither on the order of rows nor on the partitioning. NaN and
# infinities go through the high limb; larger totals are rounded there like any double.
MONEY_UNIT, RATE_UNIT = 1e6, 1e12
LIMB_BITS = 22
LIMB_MASK = (1 << LIMB_BITS) - 1
HIGH = 2.0 ** (2 * LIMB_BITS)
LIMBS = ("_h_", "_m_", "_l_")


def limb_sums(name: str, column: str, unit: float) -> List[Column]:
    """Sums of the three limbs of a double column, named after ``name``. The repeated parts
    are evaluated once a row (Spark's subexpression elimination)."""
    units = F.rint(F.col(column) * F.lit(unit))
    high = F.rint(units * F.lit(1 / HIGH))
    rest = F.nanvl(units - high * F.lit(HIGH), F.lit(0.0)).cast("bigint")
    parts = (high, F.shiftright(rest, LIMB_BITS), rest.bitwiseAND(F.lit(LIMB_MASK)))
    return [F.sum(x).alias(limb + name) for limb, x in zip(LIMBS, parts)]


def summary_aggregates() -> List[Column]:
    """Raw aggregates (all null on empty input)."""
    aggs = []
    for name, src in _SUMS:
        aggs += limb_sums(name, src, MONEY_UNIT)
    for name, src in _AVGS:
        aggs += [*limb_sums(name, src, RATE_UNIT), F.count(src).alias("_n_" + name)]
    aggs.append(F.count(F.lit(1)).alias("facility_count"))
    return aggs


def summary_names() -> List[str]:
    """Names of the columns of ``summary_aggregates``; each is merged by summing."""
    names = [limb + name for name, _ in _SUMS for limb in LIMBS]
    names += [c for name, _ in _AVGS for c in (*[limb + name for limb in LIMBS], "_n_" + name)]
    return [*names, "facility_count"]


def summary_merge() -> List[Column]:
    """Aggregates of ``summary_aggregates`` over groups, merged."""
    return [F.sum(n).alias(n) for n in summary_names()]


def _total(name: str, unit: float) -> Column:
    """The sum that limbs stand for, rounded once."""
    high, middle, low = (F.col(limb + name) for limb in LIMBS)
    carried = middle + F.shiftright(low, LIMB_BITS)
    whole = high + F.shiftright(carried, LIMB_BITS).cast("double")
    rest = F.shiftleft(carried.bitwiseAND(F.lit(LIMB_MASK)), LIMB_BITS) + low.bitwiseAND(F.lit(LIMB_MASK))
    return (whole * F.lit(HIGH) + rest.cast("double")) / F.lit(unit)


def summary_finish(keys: Sequence[str] = ()) -> List[Column]:
    """Post-aggregation: null -> 0, ratio of sums, EL rate over (sum EAD or 1)."""
    zero = F.lit(0.0)
    out = [F.col(k) for k in keys]
    total = {name: _total(name, MONEY_UNIT) for name, _ in _SUMS}
    out += [F.coalesce(c, zero).alias(name) for name, c in total.items()]
    cap, inc = total["total_economic_capital"], total["total_net_income"]
    out.append(F.when(F.coalesce(cap, zero) > zero, F.coalesce(inc, zero) / cap)
               .otherwise(zero).alias("portfolio_raroc"))
    for name, _ in _AVGS:
        out.append(F.coalesce(F.try_divide(_total(name, RATE_UNIT), F.col("_n_" + name).cast("double")), zero).alias(name))
    denom = F.coalesce(F.nullif(total["total_exposure"], zero), F.lit(1.0))
    out.append((F.coalesce(total["total_expected_loss"], zero) / denom).alias("expected_loss_rate"))
    out.append(F.coalesce("facility_count", F.lit(0).cast("bigint")).alias("facility_count"))
    return out


def limb_total(raw: dict, name: str, unit: float) -> float | None:
    """``_total`` for one already-collected row."""
    high, middle, low = (raw.get(limb + name) for limb in LIMBS)
    if high is None:
        return None
    carried = middle + (low >> LIMB_BITS)
    whole = high + float(carried >> LIMB_BITS)
    return (whole * HIGH + float(((carried & LIMB_MASK) << LIMB_BITS) + (low & LIMB_MASK))) / unit


def finish_summary(raw: dict) -> dict:
    """``summary_finish`` for one already-collected row of ``summary_aggregates``
    (same rules: null -> 0, ratio of sums, EL rate over (sum EAD or 1))."""
    def total(name, unit):
        return limb_total(raw, name, unit)

    sums = {name: total(name, MONEY_UNIT) for name, _ in _SUMS}
    out = {name: 0.0 if v is None else v for name, v in sums.items()}
    cap, inc = out["total_economic_capital"], out["total_net_income"]
    # NaN orders above every number in Spark, so a NaN capital takes the ratio branch
    out["portfolio_raroc"] = inc / cap if (cap > 0 or cap != cap) else 0.0
    for name, _ in _AVGS:
        v, n = total(name, RATE_UNIT), raw.get("_n_" + name)
        out[name] = 0.0 if v is None or not n else v / n
    out["expected_loss_rate"] = out["total_expected_loss"] / (out["total_exposure"] or 1.0)
    out["facility_count"] = int(raw.get("facility_count") or 0)
    return out


DECISIONS = ("risk_rating", "pricing_recommendation")


def decision_counts(priced: DataFrame, *keys: str) -> DataFrame:
    """(keys..., rating, recommendation, count): at most 35 groups a key."""
    return priced.groupBy(*keys, *DECISIONS).agg(F.count(F.lit(1)).alias("count"))


def distributions_of(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys..., dimension, value, count) from ``decision_counts``: the few groups are
    unpivoted, not the rows."""
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in DECISIONS]))
    return counts.select(*keys, both.alias("_d"), "count") \
                 .groupBy(*keys, F.col("_d.dimension").alias("dimension"), F.col("_d.value").alias("value")) \
                 .agg(F.sum("count").alias("count"))


def portfolio_report(priced: DataFrame) -> DataFrame:
    """One row with the summary and both distributions (sorted arrays of value and count),
    from one pass: rows are aggregated by the two decisions (at most 35 groups), and the
    totals and distributions are taken from the groups."""
    return report_of(priced.groupBy(*DECISIONS).agg(*summary_aggregates()))


def report_of(groups: DataFrame) -> DataFrame:
    """The report from aggregates by the two decisions."""
    pairs = [F.collect_list(F.struct(F.col(c).alias("value"), F.col("facility_count").alias("count"))).alias("_" + c) for c in DECISIONS]
    return groups.agg(*summary_merge(), *pairs).select(
        *summary_finish(), *[_folded(F.col("_" + c)).alias(c.replace("risk_rating", "risk_distribution")
                                                           .replace("pricing_recommendation", "recommendation_distribution"))
                             for c in DECISIONS])


def _folded(pairs: Column) -> Column:
    values = F.array_sort(F.array_distinct(F.transform(pairs, lambda x: x["value"])))
    return F.transform(values, lambda v: F.struct(v.alias("value"), F.aggregate(
        F.filter(pairs, lambda x: x["value"].eqNullSafe(v)), F.lit(0).cast("bigint"), lambda n, x: n + x["count"]).alias("count")))


def portfolio_summary(priced: DataFrame) -> DataFrame:
    """One row: totals, unweighted averages, portfolio RAROC and EL rate."""
    return priced.agg(*summary_aggregates()).select(*summary_finish())


def grouped_summary(priced: DataFrame, *keys: str) -> DataFrame:
    return priced.groupBy(*keys).agg(*summary_aggregates()).select(*summary_finish(keys))


def distribution(priced: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys..., value, count) - real counts in a ``count`` column."""
    return priced.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("count"))


def risk_distribution(priced: DataFrame) -> DataFrame:
    return distribution(priced, "risk_rating")


def recommendation_distribution(priced: DataFrame) -> DataFrame:
    return distribution(priced, "pricing_recommendation")


def product_summary(priced_products: DataFrame) -> DataFrame:
    """Sum/avg/max/min of unit final_price, total quantity and product count in one pass.

    total_revenue sums unit prices; quantity is not multiplied in."""
    zero = F.lit(0.0)
    agg = priced_products.agg(
        *limb_sums("rev", "final_price", MONEY_UNIT), F.count("final_price").alias("_n"),
        F.max("final_price").alias("_max"), F.min("final_price").alias("_min"),
        F.sum(F.col("quantity").cast("bigint")).alias("_qty"),
        F.count(F.lit(1)).alias("total_products"))
    return agg.select(
        F.coalesce(_total("rev", MONEY_UNIT), zero).alias("total_revenue"),
        F.coalesce(F.try_divide(_total("rev", MONEY_UNIT), F.col("_n").cast("double")), zero).alias("average_price"),
        F.coalesce("_max", zero).alias("max_price"),
        F.coalesce("_min", zero).alias("min_price"),
        F.coalesce("_qty", F.lit(0).cast("bigint")).alias("total_quantity"),
        F.col("total_products"))
