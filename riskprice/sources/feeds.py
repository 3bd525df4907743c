"""Facility feeds whose files differ in their columns.

Which columns a file has decides which formulas apply to its rows, and a Parquet reader
fills a column that a file lacks with nulls, which are something else. So the files are
grouped by the known columns that they carry, each group is read with its own schema, and
the groups are priced one by one and united (``price_feeds``): a plan for each different
set of columns, not for each file.

What a file carries is looked up where the data is: Parquet footers and the first lines of
CSV files in tasks over the list of files, JSON keys by an aggregation over the rows.
"""

from __future__ import annotations

from typing import Dict, Iterable, Iterator, List, Optional, Tuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facilities import price_facilities
from ..params import RiskParams
from ..schemas import feed_schema
from . import files


def _footer_columns(batches: Iterator) -> Iterator:
    """Columns of Parquet files, by their footers (null where the store is not known here)."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs
    for b in batches:
        found = []
        for path in b.column(0).to_pylist():
            try:
                store, place = fs.FileSystem.from_uri(path)
                found.append(pq.read_schema(place, filesystem=store).names)
            except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
                found.append(None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], names=["file", "columns"])


def columns_by_file(spark: SparkSession, path: str, fmt: str = "parquet") -> Dict[str, List[str]]:
    """The columns of each file of a feed, in the file's order. JSON: every key of any row."""
    if fmt not in files.FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; expected one of {files.FORMATS}")
    if fmt == "parquet":
        names = spark.read.parquet(path).inputFiles()
        tasks = max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism))
        rows = spark.createDataFrame([(n,) for n in names], "file string").repartition(tasks) \
                    .mapInArrow(_footer_columns, "file string, columns array<string>").collect()
        return {r["file"]: r["columns"] if r["columns"] is not None else spark.read.parquet(r["file"]).columns for r in rows}
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    if fmt == "csv":
        numbered = lines.withColumn("row", F.monotonically_increasing_id())        # ascends within the block
        first = numbered.where("at = 0").groupBy("file").agg(F.min_by("value", "row").alias("line"))
        return {r["file"]: _csv_header(r["line"]) for r in first.collect()}
    keys = lines.select("file", F.explode_outer(F.json_object_keys("value")).alias("key")).distinct()
    named = keys.groupBy("file").agg(F.sort_array(F.collect_set("key")).alias("columns"))
    return {r["file"]: r["columns"] for r in named.collect()}


def _csv_header(line: str) -> List[str]:
    import csv
    return next(csv.reader([line]), [])


def groups(spark: SparkSession, path: str, fmt: str = "parquet") -> List[Tuple[List[str], List[str]]]:
    """(columns, files) for each different set of known columns; CSV files are told apart by
    their whole header, as they are read by it. A file without a required column is an error."""
    found: Dict[tuple, List[str]] = {}
    for name, columns in sorted(columns_by_file(spark, path, fmt).items()):
        if not columns and fmt != "parquet":
            continue                                        # an empty text file has no rows
        try:
            known = feed_schema(columns).fieldNames()
        except ValueError as e:
            raise ValueError(f"{name}: {e}") from None
        found.setdefault(tuple(columns if fmt == "csv" else known), []).append(name)
    return [(list(c), names) for c, names in found.items()]


def facility_feeds(spark: SparkSession, path: str, fmt: str = "parquet", keep_unreadable: bool = False) -> List[DataFrame]:
    """One DataFrame for each different set of known columns among the files of ``path``."""
    parts = groups(spark, path, fmt)
    if len(parts) == 1:
        return [files.read_facilities(spark, path, fmt, parts[0][0], keep_unreadable)]
    return [files.read_facilities(spark, names, fmt, columns, keep_unreadable, base=path) for columns, names in parts]


def united(feeds: Iterable[DataFrame]) -> DataFrame:
    """The rows of all feeds; a column that a feed lacks is null in its rows."""
    feeds = list(feeds)
    if not feeds:
        raise ValueError("no feeds")
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def price_feeds(feeds: Iterable[DataFrame], pd_model: str = "logistic", lgd_model: str = "hybrid",
                rp: Optional[RiskParams] = None) -> DataFrame:
    """Every row priced by the columns of its own file."""
    return united(price_facilities(f, pd_model, lgd_model, rp) for f in feeds)
