"""Sinks that know their checkpoint, and a sink with several outputs from one read.

``bind`` writes an id into the checkpoint and into the sink before the first batch, and
compares them at every start: a checkpoint of another sink, a new checkpoint on a used sink
and a used checkpoint on a new sink are refused.

``start_checked_stream`` reads the source once: each micro-batch is checked, its valid rows
are priced, and both sides are written together under the batch's number, so priced +
rejected = input holds after every batch, and a replayed batch writes the same folder again.
"""

from __future__ import annotations

import uuid
from typing import Iterable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.facilities import price_facilities
from ..operators.publish import checked_rows, children, read_text, replace_text
from ..operators.quality import FACILITY_RULES
from ..params import RiskParams
from ..schemas import ABSENT_OK, CORRUPT, FACILITY_SCHEMA, feed_schema

SINK_ID = "_sink_id"


def _used(spark: SparkSession, folder: str) -> bool:
    return any(not name.startswith((".", "_")) for name in children(spark, folder))


def bind(spark: SparkSession, sink_dir: str, checkpoint: str) -> str:
    """The id that sink and checkpoint share; ValueError if they do not belong together.

    The checkpoint gets the id first, so a start that is killed between the two leaves a
    pair that can still be bound: an unused sink and a checkpoint without batches."""
    sink_dir, checkpoint = sink_dir.rstrip("/"), checkpoint.rstrip("/")
    in_sink, in_checkpoint = (read_text(spark, f"{d}/{SINK_ID}") for d in (sink_dir, checkpoint))
    if in_sink is not None and in_sink == in_checkpoint:
        return in_sink
    fresh = in_sink is None and not _used(spark, sink_dir) and not children(spark, f"{checkpoint}/offsets")
    if not fresh:
        raise ValueError(f"{sink_dir} belongs to another checkpoint than {checkpoint}, or that checkpoint to another sink: "
                         "go on with the pair that was used, or start with an empty folder and a new checkpoint")
    new = in_checkpoint or uuid.uuid4().hex
    if in_checkpoint is None:
        replace_text(spark, f"{checkpoint}/{SINK_ID}", new)
    replace_text(spark, f"{sink_dir}/{SINK_ID}", new)
    return new


def start_checked_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: Optional[str] = None,
                         name: str = "checked_facilities", available_now: bool = False, interval: Optional[str] = None,
                         fmt: str = "parquet", pd_model: str = "logistic", lgd_model: str = "hybrid", rp: Optional[RiskParams] = None,
                         columns: Optional[Iterable[str]] = None, max_files_per_trigger: Optional[int] = None) -> StreamingQuery:
    """Priced and rejected rows of a folder of facility files, from one read of each file."""
    from . import pricing
    schema = FACILITY_SCHEMA if columns is None else feed_schema(columns)
    stream = pricing.file_stream(spark, source_dir, schema, fmt, max_files_per_trigger)

    def write_batch(batch: DataFrame, number: int) -> None:
        rows = checked_rows(batch, FACILITY_RULES, lambda df: price_facilities(df, pd_model, lgd_model, rp), ABSENT_OK)
        rows.write.mode("overwrite").partitionBy("accepted").parquet(f"{sink_dir}/batches/batch={number}")

    checkpoint = checkpoint or pricing.default_checkpoint(spark, name, source_dir, sink_dir)
    bind(spark, sink_dir, checkpoint)
    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).queryName(name)
    return pricing.trigger(writer, available_now, interval).start()


def read_batches(spark: SparkSession, sink_dir: str, accepted: bool = True, first: int = 0, last: Optional[int] = None) -> DataFrame:
    """Priced rows, or rejected rows with ``validation_errors``, of the batches ``first`` to
    ``last`` (all: None), with their ``batch`` number; only that side and these are read."""
    rows = spark.read.parquet(f"{sink_dir}/batches").where((F.col("accepted") == F.lit(accepted)) & (F.col("batch") >= F.lit(first)))
    if last is not None:
        rows = rows.where(F.col("batch") <= F.lit(last))
    return rows.drop("accepted", "validation_errors", CORRUPT) if accepted else rows.drop("accepted")
