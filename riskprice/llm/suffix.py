"""Repeated passages by a sparse suffix array.

1. **Retained suffixes.** Of all suffixes of a text only those are kept that begin at a
   minimiser: in each run of ``min_words`` words the short window (``K`` words) with the
   smallest hash. The choice depends on the words alone, so a passage of ``min_words`` words
   that stands in two documents has a retained suffix at the same place in both. About
   one suffix in 22 is kept for 50 words. Suffixes whose first ``K`` words are in no other
   document are dropped (a pre-aggregated count), which leaves few.
2. **Sorting.** Beginnings of at most ``NEIGHBOURS`` + 1 suffixes are dealt by their first words
   and sorted by the words that follow (then by the words before, backwards).
3. **Extension.** Each of these suffixes is compared with its ``NEIGHBOURS`` on both sides, which
   are all that share its beginning: right over the words that follow, left over the words
   before. Both together must reach ``min_words``. Each suffix carries ``min_words`` words of its
   right and ``min_words - K`` of its left; longer passages are the union of what their
   suffixes find, as these are never further apart than that.
4. **Crowded beginnings.** Where more suffixes share a beginning, the nearest in one order need
   not be those that agree the most on both sides together. Of these suffixes, all runs of
   ``min_words`` words whose minimiser they are go into a pre-aggregated count by their hash,
   and every run that two documents have is taken, whatever their number.

The comparison reads a sorted partition as a stream and holds only a few rows at a time,
and no beginning of many suffixes is sorted, so a passage in a third of all documents
needs no more memory than any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, substring

K = 8
NEIGHBOURS = 4


def _codes(hashes: np.ndarray) -> np.ndarray:
    """32-bit word codes, never zero (zero fills up what lies beyond a text's ends)."""
    return (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _counted(texts: DataFrame, min_words: int) -> DataFrame:
    """(h, doc_id, n): first words (hashes) of a document's retained suffixes, and their number."""
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                found = []
                for text in part.column(1):
                    short, places = substring.chosen(common.word_hashes(common.split_words(text.as_py())), K, min_words)
                    found.append(np.unique(short[np.unique(places)], return_counts=True))
                ids = np.repeat(part.column(0).to_numpy(), [len(h) for h, _ in found])
                if len(ids):
                    yield common.batch(schema, common.signed(np.concatenate([h for h, _ in found])), ids, np.concatenate([n for _, n in found]))

    return texts.mapInArrow(run, "h long, doc_id long, n long")


def _beginnings(texts: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, parts, crowded): first words (hashes) of a document's retained suffixes that
    another document has too; crowded are those of more than ``NEIGHBOURS`` + 1 suffixes."""
    rows = _counted(texts, min_words)
    ends = rows.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("n").alias("n")).where("lo < hi") \
               .select(F.col("h").alias("_h"), (F.col("n") > NEIGHBOURS + 1).alias("many"))
    return rows.join(ends, F.col("h") == F.col("_h")).groupBy("doc_id") \
               .agg(F.collect_list(F.when(~F.col("many"), F.col("h"))).alias("parts"),
                    F.collect_list(F.when(F.col("many"), F.col("h"))).alias("crowded"))


def _runs(own_texts: DataFrame, min_words: int) -> DataFrame:
    """(h, doc_id, places) of the runs of ``min_words`` words whose minimiser is a crowded
    beginning: hash and where they start, one row for a run of a document."""
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("places", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                crowded = b.column(3)[i].values.to_numpy().view(np.uint64)
                if not len(crowded):
                    continue
                h = common.word_hashes(common.split_words(b.column(1)[i].as_py()))
                short, at = substring.chosen(h, K, min_words)
                starts = np.flatnonzero(np.isin(short[at], crowded))
                found, same = np.unique(common.window_hashes(h, min_words)[starts], return_inverse=True)
                places = np.split(starts[np.argsort(same, kind="stable")].astype(np.int32), np.cumsum(np.bincount(same))[:-1]) if len(starts) else []
                for a in range(0, len(found), 4096):
                    yield common.batch(schema, common.signed(found[a:a + 4096]), np.full(len(found[a:a + 4096]), b.column(0)[i].as_py()), places[a:a + 4096])

    return own_texts.mapInArrow(run, "h long, doc_id long, places array<int>")


def _shared(runs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, start, end, other): every run that another document has, and the smallest
    of these. For the first document of a run that is the second, for all others the first."""
    ends = runs.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi") \
               .select(F.col("h").alias("_h"), "lo")
    both = common.store(runs.join(ends, F.col("h") == F.col("_h")).select("h", "doc_id", "places", "lo"))
    later = both.where("doc_id > lo")
    second = later.groupBy("h").agg(F.min("doc_id").alias("other"))
    found = later.select("doc_id", "places", F.col("lo").alias("other")) \
                 .unionByName(both.where("doc_id = lo").join(second, "h").select("doc_id", "places", "other"))
    return found.select("doc_id", F.explode("places").alias("start"), "other") \
                .select("doc_id", "start", (F.col("start") + min_words).alias("end"), "other")


def _suffixes(own_texts: DataFrame, min_words: int) -> DataFrame:
    """(key, right, left, doc_id, places) of the retained suffixes with a beginning that is
    repeated, but not crowded.
    Suffixes of one document with the same surroundings are one row with all their places."""
    schema = pa.schema([("key", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("doc_id", pa.int64()),
                        ("places", pa.list_(pa.int32()))])
    reach = min_words - K

    def one(raw: bytes, own: np.ndarray):
        h = common.word_hashes(common.split_words(raw))
        short, at = substring.chosen(h, K, min_words)
        at = np.unique(at)
        at = at[np.isin(short[at], own)]
        code = np.concatenate((np.zeros(reach, np.uint32), _codes(h), np.zeros(min_words, np.uint32)))
        view = np.lib.stride_tricks.sliding_window_view
        for a in range(0, len(at), 4096):
            p = at[a:a + 4096]
            right = view(code, min_words)[p + reach]
            left = view(code, reach)[p][:, ::-1]
            both = np.ascontiguousarray(np.concatenate((right, left), axis=1))
            _, first, same = np.unique(both.view(np.dtype((np.void, both.shape[1] * 4))).ravel(), return_index=True, return_inverse=True)
            order = np.argsort(same, kind="stable")
            places = np.split(p[order].astype(np.int32), np.cumsum(np.bincount(same))[:-1])
            yield short[p[first]], right[first], left[first], places

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                own = b.column(2)[i].values.to_numpy().view(np.uint64)
                if len(own):
                    for key, right, left, places in one(b.column(1)[i].as_py(), own):
                        yield common.batch(schema, common.signed(key), [r.tobytes() for r in right], [x.tobytes() for x in left],
                                           np.full(len(places), b.column(0)[i].as_py()), places)

    return own_texts.mapInArrow(run, "key long, right binary, left binary, doc_id long, places array<int>")


def _equal_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row pair (zeros end it)."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def _compare(sorted_suffixes: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, start, end, other): for each suffix what its neighbours confirm, and the
    smallest of their documents. These are all suffixes with its beginning."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("other", pa.int64())])

    def table(b):
        words = lambda c, n: np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, n)
        places = np.empty(b.num_rows, object)
        for i, x in enumerate(b.column(4)):
            places[i] = x.values.to_numpy()
        return [b.column(0).to_numpy(), words(b.column(1), min_words), words(b.column(2), min_words - K),
                b.column(3).to_numpy(), places]

    def found(rows, begin, end):
        key, right, left, doc, places = rows
        n = len(key)
        far_left, far_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        other = np.full(n, np.iinfo(np.int64).max)
        for d in range(1, NEIGHBOURS + 1):
            i = np.flatnonzero((key[:-d] == key[d:]) & (doc[:-d] != doc[d:])) if n > d else np.empty(0, int)
            j = i + d
            r, x = _equal_words(right[i], right[j]), _equal_words(left[i], left[j])
            ok = r + x >= min_words
            i, j, r, x = i[ok], j[ok], r[ok], x[ok]
            for a, b in ((i, j), (j, i)):
                far_left[a], far_right[a] = np.maximum(far_left[a], x), np.maximum(far_right[a], r)
                other[a] = np.minimum(other[a], doc[b])
        hit = np.flatnonzero(far_right > 0)
        hit = hit[(hit >= begin) & (hit < end)]
        if len(hit):
            pos, n = np.concatenate(places[hit]), [len(places[i]) for i in hit]
            yield common.batch(schema, np.repeat(doc[hit], n), (pos - np.repeat(far_left[hit], n)).astype(np.int32),
                               (pos + np.repeat(far_right[hit], n)).astype(np.int32), np.repeat(other[hit], n))

    def run(batches):
        held, told = None, 0                # the last rows; the first ``told`` of them have been answered
        for b in batches:
            if not b.num_rows:
                continue
            rows = table(b) if held is None else [np.concatenate(x) for x in zip(held, table(b))]
            n = len(rows[0])
            yield from found(rows, told, n - NEIGHBOURS)
            keep = max(n - 2 * NEIGHBOURS, 0)
            told = max(told, n - NEIGHBOURS) - keep
            held = [x[keep:] for x in rows]
        if held is not None:
            yield from found(held, told, len(held[0]))

    return sorted_suffixes.mapInArrow(run, "doc_id long, start int, end int, other long")


def repeated_passages(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, start, end, other_doc_id): passages, as word positions (end exclusive), of
    ``min_words`` words or more that another document has too; overlapping ones are joined,
    and other_doc_id is the smallest document they were found in.

    A null text has no words; rows with a null doc_id are left out; repeated rows of one
    doc_id are one document. Other columns are not read. An empty table gives no rows."""
    if min_words <= K:
        raise ValueError(f"min_words must be over {K}")
    spark = docs.sparkSession
    common.prepare(spark)
    texts = docs.select("doc_id", common.text_of("text").alias("text"))
    parts = common.cut(_beginnings(texts.where("doc_id IS NOT NULL"), min_words))
    common.release(spark)
    own_texts = texts.join(parts.withColumnRenamed("doc_id", "_doc"), F.col("doc_id") == F.col("_doc")) \
                     .select("doc_id", "text", "parts", "crowded")
    shared = _shared(_runs(own_texts, min_words), min_words)
    common.release(spark)
    ordered = _suffixes(own_texts, min_words).repartition("key").sortWithinPartitions("key", "right", "left", "doc_id")
    found = _compare(ordered, min_words).unionByName(shared) \
        .groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "other")).alias("found"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("other_doc_id", pa.int64())])

    def joined(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                doc, f = b.column(0)[i].as_py(), b.column(1)[i].values
                start, end, other = (f.field(x).to_numpy() for x in range(3))
                order = np.argsort(start, kind="stable")
                start, other, reach = start[order], other[order], np.maximum.accumulate(end[order])
                first = np.concatenate(([True], start[1:] > reach[:-1])).nonzero()[0]
                last = np.append(first[1:], len(start)) - 1
                out += zip([doc] * len(first), start[first].tolist(), reach[last].tolist(), np.minimum.reduceat(other, first).tolist())
            if out:
                yield common.batch(schema, *zip(*out))

    return found.mapInArrow(joined, "doc_id long, start int, end int, other_doc_id long")
