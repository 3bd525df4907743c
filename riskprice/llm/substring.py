"""Removal of word windows that an earlier document has already, by level-wise doubling.

Level 1 counts short windows: half of the wanted length (rounded up). Of the short
windows inside a wanted window only the one with the smallest hash is counted: the choice
depends on the words alone, so a repeated wanted window has its chosen short window
repeated too, and about a quarter of the positions do for all. Only windows whose chosen
part is repeated in another document are extended to twice the length (the last step
stops at the wanted length), and so on, until the length is reached or no candidates
survive. Most windows of a corpus are unique and so never get past level 1.

Windows are compared by 64-bit hashes of their words. Each level is two shuffles of
(hash, doc_id) rows: a pre-aggregated count, and a join that brings the repeated hashes
back to their documents (a hot hash is a skewed join, which Spark splits).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def levels(window: int) -> list[int]:
    """Window lengths from the first level to ``window``."""
    first = -(-window // 2) if window > 3 else window
    out = [first]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def chosen(hashes: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all ``length``-word windows, for each ``window``-word window the position of
    its chosen one)."""
    short = common.window_hashes(hashes, length)
    return short, common.minimiser_positions(short, window - length + 1)


def _windows(raw: bytes, length: int, window: int, parts: np.ndarray | None, previous: int) -> np.ndarray:
    """Distinct hashes to count at one level. ``parts``: sorted hashes of the windows of the
    ``previous`` length that came through; only what contains one is extended."""
    h = common.word_hashes(common.split_words(raw))
    if len(h) < window:
        return np.empty(0, np.uint64)
    short, at = chosen(h, length, window)
    if parts is not None:
        before, short_at = chosen(h, previous, window)
        at = at[np.isin(before[short_at], parts)]
    return np.unique(short[at])


NONE = np.empty(0, np.uint64)
ROWS = pa.schema([("h", pa.int64()), ("doc_id", pa.int64())])


def level(docs: DataFrame, length: int, window: int, previous: int | None) -> DataFrame:
    """(h, doc_id) rows of one level; ``docs``: doc_id, text and, after level 1, parts."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                found, ids = [], []
                for i in range(part.num_rows):
                    parts = None
                    if previous is not None:
                        own = part.column(2)[i]
                        parts = np.sort(own.values.to_numpy().view(np.uint64)) if own.is_valid else NONE
                    got = NONE if parts is NONE else _windows(part.column(1)[i].as_py(), length, window, parts, previous or 0)
                    found.append(got)
                    ids.append(len(got))
                if sum(ids):
                    yield common.batch(ROWS, common.signed(np.concatenate(found)), np.repeat(part.column(0).fill_null(0).to_numpy(), ids))

    return docs.mapInArrow(run, "h long, doc_id long")


def repeated(rows: DataFrame, later_only: bool) -> DataFrame:
    """(doc_id, parts): hashes that another document has too; with ``later_only`` only for
    documents that are not the first to have them."""
    ends = rows.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi") \
               .select(F.col("h").alias("_h"), "lo")
    found = rows.join(ends, F.col("h") == F.col("_h"))
    if later_only:
        found = found.where("doc_id > lo")
    return found.groupBy("doc_id").agg(F.collect_list("h").alias("parts"))


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, parts): for each document the hashes of its ``window``-word windows that
    also start in a document with a smaller doc_id. The list is no longer than the
    document has words."""
    spark = docs.sparkSession
    common.prepare(spark)
    texts = docs.select("doc_id", common.text_of("text").alias("text"))
    parts, previous = None, None
    for length in levels(window):
        if parts is not None:
            if not parts.limit(1).count():              # no candidates survive
                return parts
            rows = level(beside(texts, parts), length, window, previous)
        else:
            rows = level(texts.where("doc_id IS NOT NULL"), length, window, None)
        if length == window:
            return repeated(rows, later_only=True)
        parts, previous = common.cut(repeated(rows, later_only=False)), length
        common.release(spark)


def beside(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, text, parts) of every row. The same left join wherever texts meet their
    hashes, so within a query Spark moves the texts once and reuses the exchange."""
    return texts.join(parts.select(F.col("doc_id").alias("_doc"), "parts"), F.col("doc_id") == F.col("_doc"), "left") \
                .select("doc_id", "text", "parts")


def remove_repeated_windows(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, kept: array of the words that stay) of every row.

    A word goes if a window of ``window`` words that covers it also starts in a document
    with a smaller doc_id; windows are those of the input. Null or empty text: no words.
    Rows with a null doc_id neither lose words nor take any. Repeated rows of one doc_id
    never remove each other's words. Other columns are not read."""
    return _apply(docs, window, digest=False)


def remove_digests(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of the same removal."""
    return _apply(docs, window, digest=True)


def _apply(docs: DataFrame, window: int, digest: bool) -> DataFrame:
    rows = beside(docs.select("doc_id", common.text_of("text").alias("text")), repeated_windows(docs, window))
    if digest:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
        ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    else:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept", pa.list_(pa.string()))])
        ddl = "doc_id long, n_words long, kept array<string>"

    def kept_words(raw: bytes, parts) -> tuple[int, list[bytes]]:
        words = common.split_words(raw)
        if parts is None or len(words) < window:
            return len(words), words
        full = common.window_hashes(common.word_hashes(words), window)
        hit = np.flatnonzero(np.isin(full, parts.to_numpy().view(np.uint64)))
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        return len(words), [w for w, c in zip(words, np.cumsum(edge[:-1]).tolist()) if not c]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, out = b.slice(at, 256), []
                for i in range(part.num_rows):
                    own = part.column(2)[i]
                    n, kept = kept_words(part.column(1)[i].as_py(), own.values if own.is_valid else None)
                    doc = part.column(0)[i].as_py()
                    if digest:
                        out.append((doc, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                    else:
                        out.append((doc, n, [w.decode("utf-8", "replace") for w in kept]))
                yield common.batch(schema, *zip(*out))

    return rows.mapInArrow(run, ddl)
