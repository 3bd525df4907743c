"""Hard negatives by threshold joins over a pruned inverted index.

For each anchor, positives are its nearest rows of the same label, and the hard negatives
of a positive are the nearest rows of other labels that score in a window just under it.
Both come from a join "all pairs of score >= t" whose threshold is lowered until the
windows are full (after L2AP: Anastasiu and Karypis, 2014):

* dimensions go in the order of their energy; a row enters the inverted lists with its
  leading dimensions only, down to where the norm of the rest times the longest anchor is
  under the threshold: the dimensions left out can't make a pair by themselves;
* partial scores are accumulated list by list, and pairs, rows and anchors go as soon as
  partial score + remaining norm x remaining norm is under the threshold;
* what is left is scored exactly in integers.

Rows with the same vector and label are one class with its smallest ids (one more than a
list holds), and so are anchors, so copies multiply neither work nor rows. Anchors are
taken in blocks of bounded size, each against all rows; partitions report their best rows
only. First thresholds come from a bounded sample of the classes, which decides about
time and never about results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LIST = 8                # dimensions of one inverted list
BLOCK = 1_024           # anchor classes compared at a time
ROWS = 4_096            # row classes indexed at a time
SAMPLE = 4_096          # classes that first thresholds come from
NO_LIMIT = float("-inf")


def vectors(rows: DataFrame, scale: int = 256, label: Column | None = None) -> DataFrame:
    """(vec_id, label, v, k1, k2) of the rows that take part: v holds floor(scale * x),
    (k1, k2) is a 128-bit key of label and vector. Rows without an id, label or vector, or
    with a component that is null or not finite, are left out; equal rows count once."""
    x = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    out = rows.where(sound).select("vec_id", (label if label is not None else F.col("label")).cast("long").alias("label"), v.alias("v"))
    return out.select("*", F.xxhash64("label", "v").alias("k1"), F.xxhash64("v", "label").alias("k2"))


def classes(rows: DataFrame, ids: int) -> DataFrame:
    """One row per label and vector, with its ``ids`` smallest vec_ids. The limit holds
    before the exchange too, so a vector with very many copies stays small."""
    smallest = Window.partitionBy("k1", "k2").orderBy("vec_id")
    few = rows.distinct().withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= ids)
    return few.groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("v").alias("v"),
                                       F.sort_array(F.collect_list("vec_id")).alias("ids"))


# ---------------------------------------------------------------- the join within a block

def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    if not len(lengths):
        return np.empty((0, 0), np.int64)
    if (lengths == lengths[0]).all():
        return values.reshape(len(lengths), lengths[0]).astype(np.int64)
    out = np.zeros((len(lengths), lengths.max()), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def _same_width(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = min(x.shape[1], q.shape[1])             # further components meet zeros
    return x[:, :d], q[:, :d]


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of rows that belong together."""
    largest = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(x.shape[1], 1)
    if largest < 2**62:
        return np.einsum("ij,ij->i", x, q)
    out = (x.astype(object) * q.astype(object)).sum(axis=1)
    if any(abs(s) >= 2**63 for s in out):
        raise OverflowError("a score does not fit a long")
    return out.astype(np.int64)


def _norms(x: np.ndarray) -> np.ndarray:
    """Norm of each row from each dimension on; (rows, dimensions + 1)."""
    squares = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(x), 1))], axis=1))


def threshold_pairs(x: np.ndarray, q: np.ndarray, t: np.ndarray, counts: dict | None = None,
                    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of every pair of a row of ``q`` and a row of ``x`` whose integer
    inner product is at least the anchor's ``t``. ``counts`` receives how many components
    were indexed and how many pairs were scored."""
    x, q = _same_width(x, q)
    xf, qf = x.astype(np.float64), q.astype(np.float64)
    order = np.argsort(-(xf * xf).sum(axis=0), kind="stable")
    xf, qf = xf[:, order], qf[:, order]
    xn, qn = _norms(xf), _norms(qf)
    slack = 1 + 1e-9                            # rounding of norms and partial scores
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(qn[:, 0] > 0, t / qn[:, 0], np.where(t > 0, np.inf, -np.inf))
    least = need.min(initial=np.inf)
    depth = (xn[:, :-1] * slack >= least).sum(axis=1) if least > 0 else np.full(len(x), x.shape[1])
    depth = -(-depth // LIST) * LIST
    rows = np.argsort(-depth, kind="stable")    # the rows of a list are then a beginning
    rows = rows[depth[rows] > 0] if least > 0 else rows
    anchors = np.flatnonzero(need < np.inf)
    xf, xn, depth = xf[rows], xn[rows], depth[rows]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    partial = np.zeros((len(anchors), len(rows)))

    def alive(part: np.ndarray, at: int, norms: np.ndarray) -> np.ndarray:
        bound = part + qn[anchors, at][:, None] * norms[:, at][None, :]
        limit = t[anchors][:, None]
        return bound + 1e-9 * np.abs(bound) + 1e-6 >= limit

    at = 0
    while len(rows) and len(anchors):
        here = int((depth > at).sum())          # rows that the list from ``at`` on holds
        if here < len(rows):                    # the others are through
            a, r = np.nonzero(alive(partial[:, here:], min(at, x.shape[1]), xn[here:]))
            found.append((anchors[a], rows[here:][r]))
            rows, xf, xn, depth, partial = rows[:here], xf[:here], xn[:here], depth[:here], partial[:, :here]
            continue
        end = min(at + LIST, x.shape[1])
        if counts is not None:
            counts["indexed"] = counts.get("indexed", 0) + here * (end - at)
        partial += qf[anchors, at:end] @ xf[:, at:end].T
        at += LIST
        if end < x.shape[1]:
            keep = alive(partial, end, xn)
            stay, ask = keep.any(axis=0), keep.any(axis=1)
            if stay.mean() < 0.8 or ask.mean() < 0.8:
                rows, xf, xn, depth = rows[stay], xf[stay], xn[stay], depth[stay]
                anchors, partial = anchors[ask], partial[np.ix_(ask, stay)]
    a = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
    r = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
    if counts is not None:
        counts["scored"] = counts.get("scored", 0) + len(a)
    step = max(1, (1 << 22) // max(x.shape[1], 1))
    s = np.concatenate([_exact(x[r[i:i + step]], q[a[i:i + step]]) for i in range(0, len(a), step)] or [np.empty(0, np.int64)])
    good = s >= t[a]
    return a[good], r[good], s[good]


class Best:
    """The first ``k`` (higher score, then smaller id) rows of each group."""

    def __init__(self, k: int):
        self.k = k
        self.held = np.empty((3, 0), np.int64)              # group, score, vec_id

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        a = np.concatenate([self.held, np.array([group, score, ids], np.int64)], axis=1)
        a = a[:, np.lexsort((a[2], -a[1], a[0]))]
        starts = np.searchsorted(a[0], a[0], "left")
        self.held = a[:, np.arange(a.shape[1]) - starts < self.k]


FOUND = "grp long, score long, vec_id long"
_FOUND = pa.schema([("grp", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])


def _join(rows: DataFrame, q: np.ndarray, t: np.ndarray, k: int, select: Callable) -> DataFrame:
    """The best ``k`` rows of each group: ``select(anchor, row label, score)`` names the
    groups of pairs over their thresholds as (pair, group)."""
    def run(batches: Iterator[pa.RecordBatch]):
        best = Best(k)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                labels, ids = part.column(0).to_numpy(zero_copy_only=False), matrix(part.column(2))
                a, r, s = threshold_pairs(matrix(part.column(1)), q, t)
                pair, group = select(a, labels[r], s)
                r, s = r[pair], s[pair]
                n = np.diff(part.column(2).offsets.to_numpy())
                for i in range(ids.shape[1]):               # the first, second ... id of a class
                    has = n[r] > i
                    best.add(group[has], s[has], ids[r[has], i])
        yield common.batch(_FOUND, *best.held)

    first = Window.partitionBy("grp").orderBy(F.desc("score"), "vec_id")
    return rows.select("label", "v", "ids").mapInArrow(run, FOUND) \
               .withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).drop("n")


# ---------------------------------------------------------------- thresholds

def steps(scores: np.ndarray, floor: float, first: int) -> list[float]:
    """Falling thresholds: the ``first`` * 2^i-th of the sample's scores that are over
    ``floor``, then ``floor`` itself."""
    scores = np.sort(scores[scores > floor])[::-1]
    out, i = [], first
    while i <= len(scores):
        out.append(float(scores[i - 1]))
        i *= 2
    return [*out, floor]


def _lowered(schedule: list[list[float]], wanted: int, join: Callable[[np.ndarray], DataFrame], groups: int,
             folder: str, owner: np.ndarray) -> None:
    """Join at the first threshold of each group, and again with the next one for the
    groups that are not full; results of full groups are appended to ``folder``. A group
    is full with ``wanted`` rows, or at the end of its schedule."""
    level = np.zeros(groups, int)
    open_ = np.ones(groups, bool)
    while open_.any():
        t = np.array([schedule[g][level[g]] if open_[g] else np.inf for g in range(groups)])
        found = common.store(join(t))
        held = np.zeros(groups, np.int64)
        for r in found.groupBy("grp").count().collect():    # a row for each group of the block
            held[r["grp"]] = r["count"]
        full = open_ & ((held >= wanted) | (level == np.array([len(s) - 1 for s in schedule])))
        spark = found.sparkSession
        done = spark.createDataFrame(pa.table({"grp": np.flatnonzero(full), "owner": owner[full]}))
        found.join(F.broadcast(done), "grp").write.mode("append").parquet(folder)
        open_ &= ~full
        level += open_


def mine(rows: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5,
         low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each
    anchor row and each of its first ``positives`` other rows of the same label, the first
    ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score
    <= high * positive_score.

    Rows without an id, label or vector, or with a component that is null or not finite,
    take no part. Equal rows count once; rows of one id with different vectors are different
    rows, also to each other. Shorter vectors are filled up with zeros. Without anchors the
    result is empty. Other columns are not read."""
    spark = rows.sparkSession
    common.prepare(spark)
    at_once = int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_rows = vectors(rows, scale, label)
    index = common.store(classes(all_rows, max(positives + 1, negatives)).repartition(at_once, "k1"))
    anchors = common.store(all_rows.where(is_anchor).select("vec_id", "label", "v", "k1", "k2").distinct())
    asked = anchors.groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("v").alias("v"))
    n_rows, n_asked = index.count(), asked.count()
    blocks = -(-n_asked // BLOCK)
    asked = common.store(asked.withColumn("block", F.pmod("k1", F.lit(max(blocks, 1)))))
    sample = index.orderBy("k1", "k2").limit(SAMPLE).select("label", "v").toArrow()
    sx, sl = matrix(sample["v"]), sample["label"].to_numpy()
    share = len(sx) / max(n_rows, 1)            # sample scores to skip for one row on average
    folder = f"{common.checkpoint_dir(spark).rstrip('/')}/negatives-{common.unique()}"
    parts = {"positive": "k1 long, k2 long, score long, vec_id long",
             "negative": "k1 long, k2 long, positive_score long, score long, vec_id long"}
    for name, ddl in parts.items():
        spark.createDataFrame([], ddl).write.parquet(f"{folder}/{name}")
    for block in range(blocks):
        _mine_block(index, asked.where(F.col("block") == block), folder, (sx, sl, share), positives, negatives, low, high)
    found = {name: spark.read.schema(ddl).parquet(f"{folder}/{name}") for name, ddl in parts.items()}
    return _expand(anchors, found["positive"], found["negative"], positives, negatives)


def _mine_block(index: DataFrame, asked: DataFrame, folder: str, sample, positives: int, negatives: int, low: int, high: int) -> None:
    """Appends the lists of one block of anchor classes (bounded: ``BLOCK`` on average)."""
    spark = index.sparkSession
    sx, sl, share = sample
    block = asked.select("k1", "k2", "label", "v").toArrow()
    q, labels = matrix(block["v"]), block["label"].to_numpy()
    keys = spark.createDataFrame(pa.table({"owner": np.arange(len(q)), "k1": block["k1"], "k2": block["k2"]}))
    x, y = _same_width(sx, q)
    seen = y.astype(np.float64) @ x.astype(np.float64).T            # only for thresholds
    same = sl[None, :] == labels[:, None]
    wanted = positives + 1                                          # the anchor itself may be among them
    schedule = [steps(seen[a][same[a]], NO_LIMIT, int(2 * wanted * share) + 2) for a in range(len(q))]
    mine_, scratch = labels, f"{folder}/block-{common.unique()}"

    def positive_groups(a, row_label, s):
        pair = np.flatnonzero(row_label == mine_[a])
        return pair, a[pair]

    _lowered(schedule, wanted, lambda t: _join(index, q, t, wanted, positive_groups), len(q), f"{scratch}/positive", np.arange(len(q)))
    near = spark.read.parquet(f"{scratch}/positive")
    near.join(F.broadcast(keys), "owner").select("k1", "k2", "score", "vec_id").write.mode("append").parquet(f"{folder}/positive")

    # a window for each different score of a positive
    windows = sorted({(r["grp"], r["score"]) for r in near.select("grp", "score").distinct().collect()})
    windows = [(a, p) for a, p in windows if -(-low * p // 100) <= high * p // 100]
    if not windows:
        return
    owner, p = np.array(windows, np.int64).T
    bottom, top = -(-low * p // 100), high * p // 100
    other = [np.sort(seen[a][~same[a]]) for a in range(len(q))]
    schedule = [steps(other[a][other[a] <= hi], float(lo), int(2 * negatives * share) + 2) for a, lo, hi in zip(owner, bottom, top)]

    def join_negatives(t):
        asks = np.flatnonzero(t < np.inf)                           # windows, by anchor
        by_anchor = np.full(len(q), np.inf)
        np.minimum.at(by_anchor, owner[asks], t[asks])
        start = np.searchsorted(owner[asks], np.arange(len(q) + 1))
        widest = int(np.diff(start).max(initial=0))

        def negative_groups(a, row_label, s):
            pairs, groups = [], []
            differs = np.flatnonzero(row_label != mine_[a])
            for i in range(widest):                                 # an anchor's first, second ... window
                at = start[a[differs]] + i
                pair = differs[at < start[a[differs] + 1]]
                g = asks[start[a[pair]] + i]
                fits = (s[pair] >= t[g]) & (s[pair] <= top[g])
                pairs.append(pair[fits])
                groups.append(g[fits])
            return np.concatenate(pairs), np.concatenate(groups)

        return _join(index, q, by_anchor, negatives, negative_groups)

    _lowered(schedule, negatives, join_negatives, len(windows), f"{scratch}/negative", owner)
    scores = spark.createDataFrame(pa.table({"grp": np.arange(len(windows)), "positive_score": p}))
    spark.read.parquet(f"{scratch}/negative").join(F.broadcast(scores), "grp").join(F.broadcast(keys), "owner") \
         .select("k1", "k2", "positive_score", "score", "vec_id").write.mode("append").parquet(f"{folder}/negative")


def _expand(anchors: DataFrame, positive: DataFrame, negative: DataFrame, positives: int, negatives: int) -> DataFrame:
    """The lists of a class (at most positives + 1 rows with ``negatives`` rows each) for
    each of its anchor rows."""
    order = lambda c: F.sort_array(F.collect_list(c))               # noqa: E731
    hard = negative.groupBy("k1", "k2", F.col("positive_score").alias("score")) \
                   .agg(order(F.struct((-F.col("score")).alias("low"), "vec_id")).alias("hard"))
    lists = positive.join(hard, ["k1", "k2", "score"], "left").groupBy("k1", "k2") \
                    .agg(order(F.struct((-F.col("score")).alias("low"), "vec_id", "hard")).alias("near"))
    own = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c)
    itself = F.array_position(F.transform("near", lambda n: (n["vec_id"] == F.col("anchor_id")) & (n["low"] == -F.col("own"))), True)
    others = F.slice(F.filter("near", lambda _, i: i + 1 != itself), 1, positives)
    each = anchors.select(F.col("vec_id").alias("anchor_id"), "k1", "k2", own.alias("own")).join(lists, ["k1", "k2"]) \
                  .select("anchor_id", F.explode(others).alias("p")) \
                  .select("anchor_id", "p", F.posexplode("p.hard").alias("at", "n"))
    return each.select("anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("at") + 1).alias("rank"),
                       F.col("n.vec_id").alias("negative_id"), (-F.col("p.low")).alias("positive_score"),
                       (-F.col("n.low")).alias("negative_score"))
