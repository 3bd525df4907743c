"""Streaming pricing (append) and running portfolio totals (complete).

* ``start_pricing_stream`` / ``start_product_stream``: files land in a directory; each
  micro-batch is checked, valid rows are priced with the batch operators and appended to
  a Parquet sink. ``start_rejects_stream`` appends the rows that fail a rule, with
  ``validation_errors``. No state; priced + rejected = input.
* ``start_totals_stream``: the portfolio summary over everything valid seen so far.
  The state is one row of aggregation buffers (sums, counts), independent of the
  number of facilities. Each epoch replaces its own ``epoch_id`` partition, so a replayed
  epoch writes the same answer again; the last ``KEEP_EPOCHS`` are kept.

A checkpoint belongs to its sink (``sinks.bind``): another one is refused, as the sink would
skip the batches whose numbers it has seen. Checkpoints go
under ``spark.checkpoint.dir`` (a shared folder on a cluster) unless the caller names a
location. Streams name the columns of their files; the files' other columns are not read.
"""

from __future__ import annotations

import hashlib
from typing import Iterable, Optional, Tuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.facilities import price_facilities
from ..operators.portfolio import summary_aggregates, summary_finish
from ..operators.products import price_products
from ..operators.quality import FACILITY_RULES, PRODUCT_RULES, split
from ..params import ProductRules, RiskParams
from ..schemas import ABSENT_OK, CORRUPT, FACILITY_SCHEMA, PRODUCT_SCHEMA, feed_schema
from ..session import checkpoint_path
from .sinks import bind


def default_checkpoint(spark: SparkSession, name: str, source: str, sink: str) -> str:
    """<spark.checkpoint.dir>/streams/<name>-<hash of source and sink>: one checkpoint
    per (query, source, sink), so two jobs never share offsets or state."""
    norm = lambda p: p.rstrip("/")
    tag = hashlib.sha1(f"{norm(source)}\n{norm(sink)}".encode()).hexdigest()[:12]
    return checkpoint_path(spark, "streams", f"{name}-{tag}")


KEEP_EPOCHS = 3


def _files(spark: SparkSession, path: str):
    """(file system, Hadoop path) of a location."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def checked_stream(spark: SparkSession, source_dir: str, schema: StructType, rules, fmt: str = "parquet",
                   absent_ok: Iterable[str] = (), max_files_per_trigger: Optional[int] = None) -> Tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows) of a stream of files."""
    return split(file_stream(spark, source_dir, schema, fmt, max_files_per_trigger), rules, tuple(absent_ok))


def file_stream(spark: SparkSession, source_dir: str, schema: StructType, fmt: str = "parquet",
                max_files_per_trigger: Optional[int] = None) -> DataFrame:
    """All rows of a stream of files. A mistyped or unreadable row does not stop the query:
    its values are null, so it fails the rules."""
    if fmt != "parquet":
        schema = StructType(schema.fields + [StructField(CORRUPT, StringType(), True)])
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt != "parquet":
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if fmt == "csv":
        reader = reader.option("header", "true").option("enforceSchema", "false")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(source_dir)


def facility_stream(spark: SparkSession, source_dir: str, fmt: str = "parquet",
                    columns: Optional[Iterable[str]] = None,
                    max_files_per_trigger: Optional[int] = None) -> Tuple[DataFrame, DataFrame]:
    schema = FACILITY_SCHEMA if columns is None else feed_schema(columns)
    return checked_stream(spark, source_dir, schema, FACILITY_RULES, fmt, ABSENT_OK, max_files_per_trigger)


def price_stream(spark: SparkSession, source_dir: str, fmt: str = "parquet",
                 pd_model: str = "logistic", lgd_model: str = "hybrid",
                 rp: Optional[RiskParams] = None, columns: Optional[Iterable[str]] = None,
                 max_files_per_trigger: Optional[int] = None) -> DataFrame:
    """Streaming DataFrame of the valid facilities of ``source_dir``, priced. ``columns``:
    what the files have (the 17 columns of the contract when omitted)."""
    valid, _ = facility_stream(spark, source_dir, fmt, columns, max_files_per_trigger)
    return price_facilities(valid, pd_model, lgd_model, rp)


def trigger(writer, available_now: bool, interval: Optional[str]):
    if available_now:
        return writer.trigger(availableNow=True)
    if interval:
        return writer.trigger(processingTime=interval)
    return writer


def _append(df: DataFrame, spark: SparkSession, name: str, source_dir: str, sink_dir: str, checkpoint: Optional[str],
            available_now: bool, interval: Optional[str]) -> StreamingQuery:
    checkpoint = checkpoint or default_checkpoint(spark, name, source_dir, sink_dir)
    bind(spark, sink_dir, checkpoint)
    writer = (df.writeStream.format("parquet").outputMode("append").option("path", sink_dir)
                .option("checkpointLocation", checkpoint).queryName(name))
    return trigger(writer, available_now, interval).start()


def start_pricing_stream(spark: SparkSession, source_dir: str, sink_dir: str,
                         checkpoint: Optional[str] = None, name: str = "priced_facilities",
                         available_now: bool = False, interval: Optional[str] = None,
                         **pricing) -> StreamingQuery:
    return _append(price_stream(spark, source_dir, **pricing), spark, name, source_dir, sink_dir, checkpoint,
                   available_now, interval)


def start_rejects_stream(spark: SparkSession, source_dir: str, sink_dir: str,
                         checkpoint: Optional[str] = None, name: str = "rejected_facilities",
                         available_now: bool = False, interval: Optional[str] = None, fmt: str = "parquet",
                         columns: Optional[Iterable[str]] = None, max_files_per_trigger: Optional[int] = None,
                         **_pricing) -> StreamingQuery:
    """The rows that the pricing stream leaves out, with ``validation_errors``."""
    rejected = facility_stream(spark, source_dir, fmt, columns, max_files_per_trigger)[1]
    return _append(rejected, spark, name, source_dir, sink_dir, checkpoint, available_now, interval)


def start_product_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: Optional[str] = None,
                         name: str = "priced_products", available_now: bool = False, interval: Optional[str] = None,
                         fmt: str = "parquet", rules: Optional[ProductRules] = None,
                         max_files_per_trigger: Optional[int] = None) -> StreamingQuery:
    """Valid product rows, priced."""
    valid, _ = checked_stream(spark, source_dir, PRODUCT_SCHEMA, PRODUCT_RULES, fmt, (), max_files_per_trigger)
    return _append(price_products(valid, rules), spark, name, source_dir, sink_dir, checkpoint, available_now, interval)


def running_totals(priced_stream: DataFrame) -> DataFrame:
    """Portfolio summary of a priced stream (complete output mode)."""
    return priced_stream.agg(*summary_aggregates()).select(*summary_finish())


def start_totals_stream(spark: SparkSession, source_dir: str, sink_dir: str,
                        checkpoint: Optional[str] = None, name: str = "portfolio_totals",
                        available_now: bool = False, interval: Optional[str] = None,
                        **pricing) -> StreamingQuery:
    totals = running_totals(price_stream(spark, source_dir, **pricing))

    def write_epoch(batch: DataFrame, epoch_id: int) -> None:
        (batch.withColumn("epoch_id", F.lit(epoch_id)).write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic").partitionBy("epoch_id").parquet(sink_dir))
        fs, sink = _files(spark, sink_dir)
        for status in fs.listStatus(sink):
            part = status.getPath().getName().partition("epoch_id=")[2]
            if part and int(part) <= epoch_id - KEEP_EPOCHS:
                fs.delete(status.getPath(), True)

    checkpoint = checkpoint or default_checkpoint(spark, name, source_dir, sink_dir)
    bind(spark, sink_dir, checkpoint)
    writer = (totals.writeStream.outputMode("complete").foreachBatch(write_epoch)
              .option("checkpointLocation", checkpoint).queryName(name))
    return trigger(writer, available_now, interval).start()


def latest_totals(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The summary of the newest epoch (the folder holds only the last few)."""
    t = spark.read.parquet(sink_dir)
    newest = t.agg(F.max("epoch_id").alias("e")).first().e
    return t.filter(F.col("epoch_id") == F.lit(newest)).drop("epoch_id")
