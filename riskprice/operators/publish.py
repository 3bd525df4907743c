"""Checked jobs that read a feed once and publish their result at one instant.

``publish_facilities`` and ``publish_products`` check every row, price the valid ones and
write both sides in one job: ``<out>/runs/<run>/accepted=true`` has the priced rows,
``accepted=false`` the others with their ``validation_errors``. Totals, distributions and
the number of rows that fail each rule are observed in the same job, so the feed is scanned
once.

A run becomes visible with its manifest ``<out>/current.json``, which is written last and
replaced by a rename: readers (``read_published``) see the old run or the new one, never a
mixture, and a run that is killed leaves the old one readable. Runs before the last are
removed after that, except for ``keep`` of them, whose readers may still be at work.
"""

from __future__ import annotations

import json
import uuid
from typing import Dict, Iterable, List, Optional, Sequence, Union

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..schemas import ABSENT_OK, CORRUPT
from .facilities import price_facilities
from .portfolio import DECISIONS, MONEY_UNIT, finish_summary, limb_sums, limb_total, summary_aggregates
from .products import price_products
from .quality import FACILITY_RULES, PRODUCT_RULES, Rule, errors_column

MANIFEST = "current.json"
DISTRIBUTION_VALUES = {
    "risk_rating": [r for r, _ in P.RATING_BANDS] + [P.RATING_OTHERWISE],
    "pricing_recommendation": [r for r, _ in P.RECOMMENDATION_BANDS] + [P.RECOMMENDATION_OTHERWISE],
}


# ---------------------------------------------------------------- files

def _fs(spark: SparkSession, path: str):
    """(file system, Hadoop path) of a location."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> Optional[str]:
    """A small text file of any store; None if there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text file in place: written beside and renamed over the old one."""
    jvm = spark.sparkContext._jvm
    fs, p = _fs(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(beside), fs.makeQualified(p), over)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> List[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


# ---------------------------------------------------------------- one pass

def checked_rows(feed: DataFrame, rules: Sequence[Rule], price, absent_ok: Sequence[str] = ()) -> DataFrame:
    """Every row of the feed with ``validation_errors``, ``accepted`` and the columns that
    ``price`` adds; those are null where a rule fails."""
    errors = errors_column(rules, feed.columns, absent_ok)
    checked = feed.withColumns({"validation_errors": errors}).withColumns({"accepted": F.col("validation_errors") == F.lit("")})
    priced = price(checked)
    given = [*feed.columns, "validation_errors", "accepted"]
    return priced.select(*[F.col(c) if c in given else F.when(F.col("accepted"), F.col(c)).alias(c) for c in priced.columns])


def _failures(rules: Sequence[Rule], columns: Sequence[str], absent_ok: Sequence[str]) -> List[Column]:
    """How many rows fail each rule, from the names in ``validation_errors``."""
    names = (["unreadable"] if CORRUPT in columns else []) + [
        r.name if r.column in columns else f"{r.column}_missing" for r in rules if r.column in columns or r.column not in absent_ok]
    failed = F.split("validation_errors", ",")
    return [F.count(F.when(F.array_contains(failed, n), 1)).alias(f"_fail_{n}") for n in names]


def _counted(dimension: str) -> List[Column]:
    return [F.count(F.when(F.col(dimension) == F.lit(v), 1)).alias(f"_d_{dimension}_{v}") for v in DISTRIBUTION_VALUES[dimension]]


def _finish_rules(raw: dict) -> Dict[str, int]:
    return {n[len("_fail_"):]: int(raw[n]) for n in sorted(raw) if n.startswith("_fail_") and raw[n]}


def _merged(observations: Sequence[dict]) -> dict:
    """Metrics of several feeds added up (all of them are sums and counts)."""
    out: dict = {}
    for raw in observations:
        for k, v in raw.items():
            out[k] = v if out.get(k) is None else out[k] if v is None else out[k] + v
    return out


def _publish(spark: SparkSession, out_dir: str, rows: DataFrame, observations: List[Observation], finish, fmt: str, keep: int) -> dict:
    run = uuid.uuid4().hex
    rows.write.format(fmt).partitionBy("accepted").save(f"{out_dir}/runs/{run}")
    result = finish(_merged([o.get for o in observations]))
    before = manifest(spark, out_dir)
    history = ([before["run"], *before["history"]] if before else [])[:keep]
    replace_text(spark, f"{out_dir}/{MANIFEST}", json.dumps({"run": run, "format": fmt, "schema": rows.schema.jsonValue(),
                                                             "history": history, **result}))
    for name in children(spark, f"{out_dir}/runs"):
        if before and name in before["history"] and name not in (run, *history):
            remove(spark, f"{out_dir}/runs/{name}")
    return result


def publish_facilities(feeds: Union[DataFrame, Iterable[DataFrame]], out_dir: str, pd_model: str = "logistic", lgd_model: str = "hybrid",
                       rp: Optional[P.RiskParams] = None, fmt: str = "parquet", keep: int = 1) -> dict:
    """Check, price and publish facility feeds (several where files differ in columns) in one
    pass. Returns ``summary``, ``rejected_count``, ``failures`` by rule and the two
    distributions, which the manifest holds too; accepted + rejected = input."""
    feeds = [feeds] if isinstance(feeds, DataFrame) else list(feeds)
    spark = feeds[0].sparkSession
    observations, parts = [], []
    for feed in feeds:
        rows = checked_rows(feed, FACILITY_RULES, lambda df: price_facilities(df, pd_model, lgd_model, rp), ABSENT_OK)
        metrics = [*summary_aggregates()[:-1], F.count(F.when(F.col("accepted"), 1)).alias("facility_count"),
                   F.count(F.when(~F.col("accepted"), 1)).alias("_rejected"), *_failures(FACILITY_RULES, feed.columns, ABSENT_OK)]
        for d in DECISIONS:
            metrics += _counted(d)
        observations.append(Observation(f"published-{uuid.uuid4().hex}"))
        parts.append(rows.observe(observations[-1], *metrics))
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p, allowMissingColumns=True)

    def finish(raw: dict) -> dict:
        counts = {d: {v: int(raw[f"_d_{d}_{v}"]) for v in DISTRIBUTION_VALUES[d] if raw[f"_d_{d}_{v}"]} for d in DECISIONS}
        return {"summary": finish_summary(raw), "rejected_count": int(raw["_rejected"]), "failures": _finish_rules(raw), **counts}

    return _publish(spark, out_dir, united, observations, finish, fmt, keep)


def publish_products(feed: DataFrame, out_dir: str, rules: Optional[P.ProductRules] = None, fmt: str = "parquet", keep: int = 1) -> dict:
    """The same for products; ``summary`` has the columns of ``product_summary``."""
    rows = checked_rows(feed, PRODUCT_RULES, lambda df: price_products(df, rules))
    price, accepted = F.col("final_price"), F.col("accepted")
    seen = Observation(f"published-{uuid.uuid4().hex}")
    rows = rows.observe(seen, *limb_sums("rev", "final_price", MONEY_UNIT), F.max(price).alias("max_price"), F.min(price).alias("min_price"),
                        F.sum(F.when(accepted, F.col("quantity").cast("bigint"))).alias("total_quantity"),
                        F.count(F.when(accepted, 1)).alias("total_products"), F.count(F.when(~accepted, 1)).alias("_rejected"),
                        *_failures(PRODUCT_RULES, feed.columns, ()))

    def finish(raw: dict) -> dict:
        total, n = limb_total(raw, "rev", MONEY_UNIT) or 0.0, int(raw["total_products"])
        summary = {"total_revenue": total, "average_price": total / n if n else 0.0, "max_price": raw["max_price"] or 0.0,
                   "min_price": raw["min_price"] or 0.0, "total_quantity": int(raw["total_quantity"] or 0), "total_products": n}
        return {"summary": summary, "rejected_count": int(raw["_rejected"]), "failures": _finish_rules(raw)}

    return _publish(feed.sparkSession, out_dir, rows, [seen], finish, fmt, keep)


# ---------------------------------------------------------------- readers

def manifest(spark: SparkSession, out_dir: str) -> Optional[dict]:
    """The manifest of the published run; None before the first."""
    text = read_text(spark, f"{out_dir}/{MANIFEST}")
    return json.loads(text) if text else None


def read_published(spark: SparkSession, out_dir: str, accepted: bool = True) -> DataFrame:
    """The priced rows of the published run, or its rejected ones with ``validation_errors``
    (only that side is read). The frame stays with its run while a newer one is published."""
    from pyspark.sql.types import StructType
    m = manifest(spark, out_dir)
    if m is None:
        raise ValueError(f"nothing has been published in {out_dir}")
    schema = StructType.fromJson(m["schema"])
    side = spark.read.schema(schema).format(m["format"]).load(f"{out_dir}/runs/{m['run']}") \
                .where(F.col("accepted") == F.lit(accepted)).drop("accepted")
    return side.drop("validation_errors", CORRUPT) if accepted else side
