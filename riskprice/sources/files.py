"""File sources and sinks with explicit schemas (never inferred).

Readers take a path or directory of parquet, JSON-lines or CSV files; the types are
applied on read so that Parquet column pruning / filter pushdown still work and
type drift in a feed fails loudly instead of silently widening columns. Which columns a
facility feed has decides which formulas apply, so ``read_facilities`` reads exactly the
known columns that the feed carries, in every format.
"""

from __future__ import annotations

from typing import Iterable, List, Optional, Union

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import CORRUPT, PRODUCT_SCHEMA, feed_schema

FORMATS = ("parquet", "json", "csv")


def _reader(spark: SparkSession, schema: StructType, fmt: str):
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; expected one of {FORMATS}")
    r = spark.read.schema(schema).format(fmt)
    return reader_options(r, fmt)


def reader_options(r, fmt: str):
    """CSV: header checked against the schema names (never mapped by position);
    CSV and JSON: a malformed or mistyped value fails the job instead of reading as null."""
    if fmt == "csv":
        r = r.option("header", "true").option("enforceSchema", "false")
    if fmt in ("csv", "json"):
        r = r.option("mode", "FAILFAST")
    return r


def columns_present(spark: SparkSession, path: str, fmt: str) -> list:
    """Column names of a feed: a Parquet footer, the CSV header, or the keys of all JSON
    rows (one pass; name the columns instead to spare it). A path that can't be read is an
    error."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; expected one of {FORMATS}")
    if fmt == "parquet":
        return spark.read.parquet(path).columns
    if fmt == "csv":
        return spark.read.option("header", "true").csv(path).columns
    return [c for c in spark.read.option("primitivesAsString", "true").json(path).columns if c != CORRUPT]


def read(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """Any table written by these jobs, with its known schema."""
    return _reader(spark, schema, fmt).load(path)


def read_products(spark: SparkSession, path: str, fmt: str = "parquet", keep_unreadable: bool = False) -> DataFrame:
    r = _reader(spark, PRODUCT_SCHEMA, fmt)
    if keep_unreadable and fmt != "parquet":
        schema = StructType(PRODUCT_SCHEMA.fields + [StructField(CORRUPT, StringType(), True)])
        r = r.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return r.load(path)


def read_facilities(spark: SparkSession, path: Union[str, List[str]], fmt: str = "parquet",
                    columns: Optional[Iterable[str]] = None, keep_unreadable: bool = False,
                    base: Optional[str] = None) -> DataFrame:
    """Facility feed with the known columns that it has (``columns`` names them, else they
    are looked up), so an absent optional column is absent for the formulas too. Files that
    differ in their known columns are an error here: ``feeds.facility_feeds`` reads them.
    ``base``: the folder that ``path`` lists files of.

    ``keep_unreadable``: rows of JSON and CSV feeds that can't be parsed stay as nulls with
    their text in ``_corrupt_record``, for the quarantine, instead of failing the job."""
    present = columns_present(spark, path, fmt) if columns is None else list(columns)
    schema = known = feed_schema(present)
    if columns is None and fmt == "parquet":
        _same_columns(spark, path, known)
    if fmt == "csv":                    # the header is checked, so every column of it is declared
        schema = StructType([known[c] if c in known.fieldNames() else StructField(c, StringType(), True) for c in present])
    r = _reader(spark, schema, fmt)
    if base:
        r = r.option("basePath", base)
    if keep_unreadable and fmt != "parquet":
        schema = StructType(schema.fields + [StructField(CORRUPT, StringType(), True)])
        r = r.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return r.load(path).select(*known.fieldNames(), *[c for c in (CORRUPT,) if c in schema.fieldNames()])


def _same_columns(spark: SparkSession, path, known: StructType) -> None:
    """All footers carry the same known columns."""
    from .feeds import groups
    parts = groups(spark, path)
    if len(parts) > 1:
        sets = [set(c) for c, _ in parts]
        differ = sorted(set.union(*sets) - set.intersection(*sets))
        raise ValueError(f"the files of {path} differ in the columns {differ}: read them with feeds.facility_feeds")


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
          partition_by: Optional[Iterable[str]] = None) -> None:
    """Distributed write (one file per task); nothing passes through the driver."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def as_json(df: DataFrame, key: str) -> DataFrame:
    """(key, json) with every column of the row serialised as one JSON object."""
    return df.select(F.col(key), F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("json"))
