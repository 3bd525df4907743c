"""Helpers shared by the corpus operators: inputs, words, checkpoints, components."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Python workers find this package, and checkpoint() has its folder.

    The package root goes into the workers' PYTHONPATH (a cluster without a shared
    install gets the package by --py-files instead). The checkpoint folder is the one
    that the session names in ``spark.checkpoint.dir``; only a session without that
    setting and in local mode (tests) gets a scratch folder of its own."""
    sc = spark.sparkContext
    path = sc.environment.get("PYTHONPATH", "")
    if PACKAGE_ROOT not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (PACKAGE_ROOT, path) if x)
    checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written files."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            sc.setCheckpointDir(named)
        return named
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="riskprice-llm-")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, its lineage cut; survives lost executors."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Best effort to have the shuffle files of finished phases removed before the next one
    writes its own: Spark removes them once the driver's JVM has collected what held them,
    so that is asked for four times, as Python lets go of its handles in the background. What was
    checkpointed before does not need them; results do not depend on this."""
    import gc
    import time
    for _ in range(4):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def text_of(column: str = "text") -> Column:
    """A text as UTF-8 bytes (null: empty)."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def split_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text: exactly what bytes.split() yields."""
    return raw.split()


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    """64-bit hash of each word."""
    import xxhash
    h = xxhash.xxh3_64_intdigest
    each = (h(w, seed) for w in words) if seed else map(h, words)          # without a seed the library's is 0
    return np.fromiter(each, np.uint64, len(words))


MIX = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (empty if there are fewer).

    Built by doubling: a window's hash mixes the hashes of its first half and its last
    half, so log2(n) vectorised passes do for any n."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    level, length = h, 1
    while length < n:
        step = min(length, n - length)          # the last level overlaps its halves
        a, b = level[:len(level) - step], level[step:]
        level = (a ^ (a >> np.uint64(29))) * MIX + (b ^ (b >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        level ^= level >> np.uint64(31)
        length += step
    return level


def minimiser_positions(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` consecutive hashes, the position of the smallest
    (leftmost on ties); fewer hashes than ``w`` make no run."""
    n = len(h) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.empty(n, np.int64)
    for at in range(0, n, 1 << 16):             # bounded scratch memory for very long texts
        part = np.lib.stride_tricks.sliding_window_view(h[at:min(at + (1 << 16), n) + w - 1], w)
        out[at:at + len(part)] = part.argmin(axis=1) + np.arange(at, at + len(part))
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t.type)
                                       for c, t in zip(columns, schema)], schema=schema)


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the
    smallest node that can be reached.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round is
    two grouped aggregations over the edges, the number of rounds grows with the
    logarithm of the node count, and no node gathers its neighbours as a list. Every
    round is checkpointed. Self-loops and null ends are ignored."""
    spark = edges.sparkSession
    prepare(spark)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")) \
             .where(F.col("u") > F.col("v")).distinct()
    e = cut(e)
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node points to the node's smallest neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")) \
                    .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: every smaller neighbour points to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u"))
                                            .otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = cut(small.where("u > v").distinct())
        # settled once every node has one edge and no target is itself a source
        sources = new.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        forks = sources.where("n > 1").limit(1).count()
        chains = 0 if forks else new.select(F.col("v").alias("u")).distinct().join(sources, "u", "left_semi").limit(1).count()
        e = new
        if not forks and not chains:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")) \
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def unique() -> str:
    """A name that no other run uses."""
    return uuid.uuid4().hex


def store(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the checkpoint folder and read again. Unlike after
    checkpoint(), the planner then knows the real size, and broadcasts the table only
    where it is under Spark's own limit."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored-{unique()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
