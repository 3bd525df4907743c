"""Feeds whose join needs no shuffle: both sides are stored by their join key.

``write_pair`` stores a fact table and its dimension in the same number of buckets of
(key, salt). The salt spreads the rows of one key over several buckets, so a key that holds
a large share of the rows does not make one long task (a join of buckets is not split at run
time); the dimension, the smaller side, is stored once for each salt. Each bucket is one
sorted file, so recurring runs read both sides and merge them where they lie.

Buckets are known to Spark through its catalog only. A manifest beside the files holds their
description, and ``join_pair`` registers them in the session's catalog when they are not
there yet, so a persistent metastore is not needed.
"""

from __future__ import annotations

import json
from typing import List

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..operators.publish import read_text, replace_text
from . import tables

MANIFEST = "buckets.json"
SALT = "_salt"


def _write(df: DataFrame, path: str, key: str, buckets: int) -> None:
    df.repartition(buckets, key, SALT).sortWithinPartitions(key, SALT) \
      .write.mode("overwrite").format("parquet").bucketBy(buckets, key, SALT).sortBy(key, SALT).option("path", path) \
      .saveAsTable(_name(path))


def _name(path: str) -> str:
    """A table name that belongs to the folder."""
    import hashlib
    return "bucketed_" + hashlib.sha1(path.encode()).hexdigest()[:16]


def write_pair(fact: DataFrame, dimension: DataFrame, folder: str, fact_key: str, dimension_key: str, spread: List[str],
               buckets: int, salts: int = 8) -> None:
    """Store both sides under ``folder``. ``spread``: columns of the fact table that differ
    among the rows of a key. A null key joins nothing and is not stored.

    Both keys must have one type; ``buckets`` should leave a few hundred megabytes of the
    fact table in each."""
    types = [dict(d.dtypes)[k] for d, k in ((fact, fact_key), (dimension, dimension_key))]
    if types[0] != types[1]:
        raise ValueError(f"the keys have different types: {types[0]} and {types[1]}")
    if buckets < 1 or salts < 1:
        raise ValueError("buckets and salts are at least one")
    salted = fact.where(F.col(fact_key).isNotNull()).withColumn(SALT, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = dimension.where(F.col(dimension_key).isNotNull()) \
                      .withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    _write(salted, f"{folder}/fact", fact_key, buckets)
    _write(copies, f"{folder}/dimension", dimension_key, buckets)
    sides = {name: {"key": key, "columns": [[f.name, f.dataType.simpleString()] for f in df.schema.fields]}
             for name, key, df in (("fact", fact_key, salted), ("dimension", dimension_key, copies))}
    replace_text(fact.sparkSession, f"{folder}/{MANIFEST}", json.dumps({"buckets": buckets, "salts": salts, **sides}))


def _attach(spark: SparkSession, path: str, side: dict, buckets: int) -> DataFrame:
    name = _name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"{quoted(c)} {t}" for c, t in side["columns"])
        by = f"{quoted(side['key'])}, {quoted(SALT)}"
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS "
                  f"LOCATION '{path}'")
    return spark.table(name)


def join_pair(spark: SparkSession, folder: str) -> DataFrame:
    """The fact rows with their dimension's columns (inner join)."""
    text = read_text(spark, f"{folder}/{MANIFEST}")
    if text is None:
        raise ValueError(f"{folder} holds no buckets")
    m = json.loads(text)
    fact, dimension = (_attach(spark, f"{folder}/{s}", m[s], m["buckets"]) for s in ("fact", "dimension"))
    same = (fact[m["fact"]["key"]] == dimension[m["dimension"]["key"]]) & (fact[SALT] == dimension[SALT])
    return fact.join(dimension, same).drop(SALT)


def write_facility_tables(spark: SparkSession, sf_dir: str, folder: str, buckets: int, salts: int = 8) -> None:
    """Orders and customers by the customer's key."""
    write_pair(tables.table(spark, sf_dir, "orders").select(*tables.ORDER_COLUMNS),
               tables.table(spark, sf_dir, "customer").select(*tables.CUSTOMER_COLUMNS), folder, "o_custkey", "c_custkey",
               ["o_orderkey"], buckets, salts)


def facilities(spark: SparkSession, sf_dir: str, folder: str, spoiled: bool = False) -> DataFrame:
    """``tables.facilities`` from tables stored by ``write_facility_tables``."""
    return tables.facilities_of(join_pair(spark, folder), tables.region_dimension(spark, sf_dir), spoiled)


def write_product_tables(spark: SparkSession, sf_dir: str, folder: str, buckets: int, salts: int = 8) -> None:
    """Line items and parts by the part's key."""
    write_pair(tables.table(spark, sf_dir, "lineitem").select(*tables.LINE_COLUMNS),
               tables.table(spark, sf_dir, "part").select(*tables.PART_COLUMNS), folder, "l_partkey", "p_partkey",
               ["l_orderkey", "l_quantity"], buckets, salts)


def product_lines(spark: SparkSession, sf_dir: str, folder: str, spoiled: bool = False) -> DataFrame:
    """``tables.product_lines`` from tables stored by ``write_product_tables``."""
    return tables.product_lines_of(join_pair(spark, folder), spoiled)
