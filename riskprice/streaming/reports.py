"""Running report of a stream of facilities: totals, both distributions and the model grid.

Instead of a state that every batch rewrites, each epoch leaves its own partial aggregates:
sums in limbs and counts by model pair and the two decisions, a few hundred rows at most
whatever the batch holds. They merge by adding, so the report is exactly that of the batch
job over all rows. Once ``compact_every`` partials have gathered they are merged into one;
a manifest that is replaced by a rename says up to which epoch. A replayed epoch writes its
own partial again, or nothing if it is merged already.
"""

from __future__ import annotations

import json
from typing import List, Optional, Tuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import model_grid, portfolio
from ..operators.publish import children, read_text, remove, replace_text
from ..params import RiskParams
from .sinks import bind

PAIR = ("model_key", "pd_model", "lgd_model")
KEYS = (*PAIR, *portfolio.DECISIONS)
MERGED = "merged.json"


def partials(facilities: DataFrame, rp: Optional[RiskParams] = None) -> DataFrame:
    """Aggregates of checked facilities by model pair, rating and recommendation."""
    return model_grid.model_grid_rows(facilities, rp).groupBy(*KEYS).agg(*portfolio.summary_aggregates())


def merge(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEYS).agg(*portfolio.summary_merge())


def _merged_upto(spark: SparkSession, sink_dir: str) -> int:
    text = read_text(spark, f"{sink_dir}/{MERGED}")
    return json.loads(text)["upto"] if text else -1


def _epochs(spark: SparkSession, sink_dir: str) -> List[int]:
    return sorted(int(n.partition("=")[2]) for n in children(spark, f"{sink_dir}/partials") if n.startswith("epoch="))


def _folders(spark: SparkSession, sink_dir: str) -> Tuple[List[str], int]:
    """Folders whose sum is the whole, and the last epoch in them."""
    upto = _merged_upto(spark, sink_dir)
    later = [e for e in _epochs(spark, sink_dir) if e > upto]
    folders = ([f"{sink_dir}/merged/upto={upto}"] if upto >= 0 else []) + [f"{sink_dir}/partials/epoch={e}" for e in later]
    return folders, max([upto, *later])


def write_epoch(facilities: DataFrame, epoch: int, sink_dir: str, rp: Optional[RiskParams] = None, compact_every: int = 20) -> None:
    """The partial of one epoch, and the merging of partials when enough have gathered."""
    spark = facilities.sparkSession
    upto = _merged_upto(spark, sink_dir)
    if epoch <= upto:
        return                                              # a replay of a merged epoch
    partials(facilities, rp).coalesce(1).write.mode("overwrite").parquet(f"{sink_dir}/partials/epoch={epoch}")
    if len([e for e in _epochs(spark, sink_dir) if e > upto]) < compact_every:
        return
    folders, last = _folders(spark, sink_dir)
    merge(spark.read.parquet(*folders)).coalesce(1).write.mode("overwrite").parquet(f"{sink_dir}/merged/upto={last}")
    replace_text(spark, f"{sink_dir}/{MERGED}", json.dumps({"upto": last}))
    for e in _epochs(spark, sink_dir):
        if e <= upto:                                       # readers of the former manifest are done with these
            remove(spark, f"{sink_dir}/partials/epoch={e}")
    for name in children(spark, f"{sink_dir}/merged"):
        if name.startswith("upto=") and int(name.partition("=")[2]) < upto:
            remove(spark, f"{sink_dir}/merged/{name}")


def start_report_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: Optional[str] = None,
                        name: str = "portfolio_report", available_now: bool = False, interval: Optional[str] = None,
                        rp: Optional[RiskParams] = None, compact_every: int = 20, **source) -> StreamingQuery:
    """Partials of the valid rows of a folder of facility files (``source``: fmt, columns,
    max_files_per_trigger)."""
    from . import pricing
    valid, _ = pricing.facility_stream(spark, source_dir, **source)
    checkpoint = checkpoint or pricing.default_checkpoint(spark, name, source_dir, sink_dir)
    bind(spark, sink_dir, checkpoint)
    writer = valid.writeStream.foreachBatch(lambda batch, epoch: write_epoch(batch, epoch, sink_dir, rp, compact_every)) \
                  .option("checkpointLocation", checkpoint).queryName(name)
    return pricing.trigger(writer, available_now, interval).start()


def _all(spark: SparkSession, sink_dir: str) -> DataFrame:
    folders, last = _folders(spark, sink_dir)
    if last < 0:
        raise ValueError(f"no epoch has been written to {sink_dir}")
    return merge(spark.read.parquet(*folders))


def latest_report(spark: SparkSession, sink_dir: str, pd_model: str = "logistic", lgd_model: str = "hybrid") -> DataFrame:
    """``portfolio_report`` of everything seen so far, for one model pair."""
    pair = (F.col("pd_model") == F.lit(pd_model)) & (F.col("lgd_model") == F.lit(lgd_model))
    return portfolio.report_of(_all(spark, sink_dir).where(pair))


def latest_grid(spark: SparkSession, sink_dir: str) -> DataFrame:
    """``model_grid`` of everything seen so far."""
    return _all(spark, sink_dir).groupBy(*PAIR).agg(*portfolio.summary_merge()).select(*portfolio.summary_finish(PAIR))


def latest_distribution(spark: SparkSession, sink_dir: str) -> DataFrame:
    """``model_grid_distribution`` of everything seen so far."""
    counts = _all(spark, sink_dir).select("model_key", *portfolio.DECISIONS, F.col("facility_count").alias("count"))
    return portfolio.distributions_of(counts, "model_key")
