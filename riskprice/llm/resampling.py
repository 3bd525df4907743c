"""Importance resampling towards a target distribution.

Features of a text are its runs of one and two words, hashed into a fixed number of
buckets. The gain of a bucket is the logarithm of its smoothed share in the target over
that in the corpus; a document's weight is the mean gain of its features, taken from
arrays. Gumbel noise, a function of the id, turns the order of the scores into sampling
without replacement in proportion to exp(weight) (Xie et al., 2023; Efraimidis and
Spirakis, 2006).

The drawn documents are those with the highest scores. The exact cutoff comes from a
weighted median of medians: every partition gives the median of its remaining keys, the
median of these, each weighted by the partition's remaining number, has at least a
quarter of all remaining keys on either side, and the counts on both sides say which
part is discarded. Only one row a partition reaches the driver in a round. Nothing but
the winners is sorted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD_BYTES = bytes(i if chr(i).isalnum() or i >= 0x80 else 0x20 for i in range(256))


def _crc_table() -> np.ndarray:
    """What each byte adds to a crc32 (reflected polynomial of IEEE 802.3)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return c


_TABLE = _crc_table()


def _then_space(crc: np.ndarray) -> np.ndarray:
    """crc32 of each hashed text with one more space."""
    c = ~crc
    return ~(_TABLE[(c ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (c >> np.uint32(8)))


def word_lists(raw: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a UTF-8 text (A-Z lower-cased; bytes outside 0-9, a-z and 0x80 on separate),
    in lists from about ``size`` bytes of the text each, so memory stays bounded."""
    flat = raw.lower().translate(WORD_BYTES)
    at = 0
    while at < len(flat):
        end = len(flat) if at + size >= len(flat) else flat.find(b" ", at + size)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def bucket_lists(raw: bytes, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the runs of one and two words that end in them), for
    each list of words of a text."""
    before = None                               # crc32 of the word before with a space
    for words in word_lists(raw):
        if not words:
            continue
        one = np.fromiter(map(crc32, words), np.uint32, len(words))
        spaced = _then_space(one)
        starts = spaced[:-1].tolist() if before is None else [before, *spaced[:-1].tolist()]
        two = np.fromiter(map(crc32, words[len(words) - len(starts):], starts), np.uint32, len(starts))
        before = int(spaced[-1])
        yield len(words), np.concatenate([one, two]) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in the column ``text``: a fixed number of integers,
    summed within each partition before they are exchanged."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column(0):
                for _, found in bucket_lists(t.as_py(), buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield common.batch(schema, at.astype(np.int32), total[at])

    rows = texts.select(common.text_of("text").alias("text")).mapInArrow(run, "bucket int, n long") \
                .groupBy("bucket").agg(F.sum("n").alias("n")).collect()     # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over that in the
    corpus, both smoothed by one, rounded down."""
    k, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + k) / ((float(a) + 1) * (t + k))))
                     for a, b in zip(corpus, target)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel variate of the id, rounded down (a null id counts as no digits)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def score(docs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    buckets = len(gain)
    schema = pa.schema([(c.split()[0], pa.int64()) for c in SCORED.split(", ")])

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = features = total = 0
                for n, found in bucket_lists(t.as_py(), buckets):
                    words, features, total = words + n, features + len(found), total + int(gain[found].sum())
                weight = total // features if features else 0
                rows.append((doc_id, words, features, weight, weight + noise(doc_id, seed)))
            yield common.batch(schema, *(zip(*rows) if rows else [[]] * 5))

    return docs.select("doc_id", common.text_of("text").alias("text")).mapInArrow(run, SCORED)


class Key(NamedTuple):
    """Place in the order: higher scores first, then smaller ids, null ids last."""
    low: int                    # minus the score
    null: int
    doc_id: int


def key_columns() -> list[Column]:
    return [(-F.col("score")).alias("low"), F.col("doc_id").isNull().cast("long").alias("null"),
            F.coalesce("doc_id", F.lit(0)).cast("long").alias("id")]


def before(a: np.ndarray, k: Key) -> np.ndarray:
    """Which rows of a (low, null, id) array come before ``k``."""
    x, y, z = a
    return (x < k.low) | ((x == k.low) & ((y < k.null) | ((y == k.null) & (z < k.doc_id))))


def _middle(a: np.ndarray) -> Key | None:
    """Lower median of a (low, null, id) array."""
    if not a.shape[1]:
        return None
    order = np.lexsort(a[::-1])
    return Key(*a[:, order[(a.shape[1] - 1) // 2]].tolist())


def weighted_median(medians: list[tuple[Key, int]]) -> Key:
    """The first of the sorted medians by which half of the weight is reached."""
    half, so_far = sum(n for _, n in medians) / 2, 0
    for k, n in sorted(medians):
        so_far += n
        if so_far >= half:
            return k
    raise ValueError("no medians")


def cutoff(keys: DataFrame, n: int, few: int = 2_000) -> Key | None:
    """The ``n``-th key of a table of (low, null, id), in order; None for n = 0. Once at
    most ``few`` keys remain they are sorted directly."""
    if n < 1:
        return None
    side = "n{0} long, low{0} long, null{0} long, id{0} long"
    ddl = f"{side.format(0)}, equal long, {side.format(1)}"

    def survey(lo: Key | None, hi: Key | None, pivot: Key | None) -> list:
        """For each partition: number and median of the keys between lo and the pivot, how
        many equal it, and number and median of those between it and hi."""
        def run(batches):
            parts = [np.empty((3, 0), np.int64)]
            for b in batches:
                a = np.array([c.to_numpy() for c in b.columns], np.int64).reshape(3, -1)
                if hi is not None:
                    a = a[:, before(a, hi)]
                if lo is not None:
                    a = a[:, ~before(a, lo) & (a != np.array([lo]).T).any(axis=0)]
                parts.append(a)
            a = np.concatenate(parts, axis=1)
            first = before(a, pivot) if pivot else np.ones(a.shape[1], bool)
            same = (a == np.array([pivot]).T).all(axis=0) if pivot else ~first
            row = []
            for side in (a[:, first], a[:, ~first & ~same]):
                row += [side.shape[1], *(_middle(side) or (0, 0, 0))]
            row.insert(4, int(same.sum()))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=[c.split()[0] for c in ddl.split(", ")])

        return keys.mapInArrow(run, ddl).where("n0 + equal + n1 > 0").collect()     # a row a partition

    lo = hi = None
    medians = [(Key(r["low0"], r["null0"], r["id0"]), r["n0"]) for r in survey(None, None, None)]
    if sum(m for _, m in medians) < n:
        raise ValueError("fewer keys than are to be drawn")
    while sum(m for _, m in medians) > few:
        pivot = weighted_median(medians)
        rows = survey(lo, hi, pivot)
        below, equal = sum(r["n0"] for r in rows), sum(r["equal"] for r in rows)
        if below < n <= below + equal:
            return pivot
        keep = 0 if n <= below else 1
        if keep:
            n, lo = n - below - equal, pivot
        else:
            hi = pivot
        medians = [(Key(r[f"low{keep}"], r[f"null{keep}"], r[f"id{keep}"]), r[f"n{keep}"]) for r in rows if r[f"n{keep}"]]
    left = keys
    if hi is not None:
        left = left.where(_place() < _place_of(hi))
    if lo is not None:
        left = left.where(_place() > _place_of(lo))
    return sorted(Key(*r) for r in left.select("low", "null", "id").collect())[n - 1]


def _place() -> Column:
    return F.struct(F.col("low"), F.col("null"), F.col("id"))


def _place_of(k: Key) -> Column:
    return F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(k, ("low", "null", "id"))])


def _ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with rank 1, 2, 3 ... in the order of their keys: sorted by ranges, the
    ranges' bases come from prefix sums of their sizes."""
    order = ["low", "null", "id", "n_features", "n_words"]
    ranges = common.store(winners.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()    # a row a range
    bases = list(zip((r["range"] for r in sizes), accumulate((r["n"] for r in sizes), initial=0)))
    base = winners.sparkSession.createDataFrame(bases, "range int, base long")
    from pyspark.sql import Window
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)).cast("long")
    return ranges.withColumn("place", place).join(base, "range").withColumn("rank", F.col("base") + F.col("place"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = 10_000,
             seed: int = 7) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``. Of the N rows
    with ``min_words`` words or more, the floor(percent * N / 100) highest scores are drawn
    and ranked from 1, ties to the smaller doc_id; other ranks are null.

    Null text: empty, no features, weight 0. Null ids come last among ties; rows that tie
    in everything are told apart by their numbers of features and words, equal rows
    arbitrarily. An empty target or corpus has no counts: smoothing alone gives the gains.
    Other columns are not read."""
    common.prepare(docs.sparkSession)
    if not 0 <= percent <= 100:
        raise ValueError(f"percent must be within 0..100, got {percent!r}")
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = common.store(score(docs, gain, seed).select("*", *key_columns()))
    able = F.col("n_words") >= min_words
    n = scored.where(able).count() * percent // 100
    last = cutoff(scored.where(able).select("low", "null", "id"), n)
    won = able & (_place() <= _place_of(last)) if last else F.lit(False)
    out = ["doc_id", "n_features", "weight", "score"]
    drawn = _ranked(scored.where(won)).select(*out, F.when(F.col("rank") <= n, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.where(~won).select(*out, F.lit(None).cast("long").alias("rank")))
