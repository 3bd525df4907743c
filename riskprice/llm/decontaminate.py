"""Benchmark decontamination: rare seeds, then Smith-Waterman alignment.

1. The test items are read in blocks of bounded size (``block_words``); a block is a table
   that every task gets, and its findings are written before the next block is read.
2. Seeds are pairs of words that stand next to each other or with one word between. A local
   alignment (match 2, mismatch -1, gap -1) of score s with m matches has at most 2m - s
   errors, so at least s / 2 - 1 of its matches are followed by the next one with no error
   or one between: both are then a seed pair in item and document alike.
3. Rarity: a first pass over the corpus counts in how many documents each pair stands. Of
   every item the most frequent pairs are left out, as long as they begin at fewer words of
   the item than the number above: an alignment that reaches the score has a rarer one, and
   only the rarer ones join documents to items.
4. The joined item and document are aligned where enough of its pairs, all of them now,
   stand close together, left and right of a passage found too. An upper bound of the score
   (``within_reach``) spares the alignment where it can't reach the need.

So every alignment that scores enough is found, copies with a word changed, added or missing
at every other word included. A document is contaminated if the score reaches ``similarity``
of a full match, or that of ``passage`` equal words in a row.

Words are lower-cased, cut at white space, and lose marks at their ends. Items of fewer
than ``min_item_words`` words have too little for an alignment to tell from chance: these
are looked for as exact sequences of words, in the same pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import STRIP

MATCH, MISMATCH, GAP = 2, -1, -1


def words_of(text: str) -> list[str]:
    return [x for w in text.lower().split() if (x := w.strip(STRIP))]


class Block(NamedTuple):
    """Items of one block, and what finds them. Pairs are codes first word * vocabulary +
    second; a code's place among ``pairs`` is its number. The items (places in the block) of
    pair g are ``items_of[first[g]:first[g + 1]]``, and likewise for its rare items."""
    vocabulary: dict[str, int]
    items: list[int]
    words: list[np.ndarray]             # word numbers of each item
    pairs: np.ndarray
    first: np.ndarray
    items_of: np.ndarray
    need: np.ndarray                    # score that makes a passage
    short: dict[tuple[str, ...], list[int]]     # items that are looked for as they are


def _close(words: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, code) of the pairs of neighbours and of those with one word between; words of
    no item (-1) make no pair."""
    out = []
    for step in (1, 2):
        a, b = words[:len(words) - step], words[step:]
        at = np.flatnonzero((a >= 0) & (b >= 0)) if len(words) > step else np.empty(0, np.int64)
        out.append((at, a[at] * base + b[at]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def build_block(items: list[tuple[int, list[str]]], similarity: float, passage: int, short: dict) -> Block:
    vocabulary: dict[str, int] = {}
    words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int64) for _, ws in items]
    own = [np.unique(_close(w, len(vocabulary))[1]) for w in words]
    codes, place = np.concatenate([*own, np.empty(0, np.int64)]), np.repeat(np.arange(len(own)), [len(c) for c in own])
    pairs, number = np.unique(codes, return_inverse=True)
    order = np.argsort(number, kind="stable")
    need = np.array([math.ceil(min(similarity * len(w), passage) * MATCH) for w in words], np.int64)
    return Block(vocabulary, [i for i, _ in items], words, pairs, np.searchsorted(number[order], np.arange(len(pairs) + 1)),
                 place[order], need, short)


def least_pairs(need: np.ndarray) -> np.ndarray:
    """How many close pairs an alignment of that score has at least."""
    return np.maximum(-(-need // 2) - 1, 1)


def rare_pairs(block: Block, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, items): the items that each pair is a rare seed of; ``documents`` is the number
    of documents that each pair stands in."""
    seeds, places = [], []
    for k, words in enumerate(block.words):
        at, codes = _close(words, len(block.vocabulary))
        number = np.searchsorted(block.pairs, codes)
        spare, covered, left_out = int(least_pairs(block.need[k])) - 1, set(), set()
        own = np.unique(number)
        for g in own[np.argsort(-documents[own], kind="stable")].tolist():
            more = covered.union(at[number == g].tolist())
            if len(more) > spare:
                break                               # one more and an alignment could do without the others
            covered = more
            left_out.add(g)
        rare = [g for g in own.tolist() if g not in left_out]
        seeds += rare
        places += [k] * len(rare)
    seeds_, places_ = np.array(seeds, np.int64), np.array(places, np.int64)
    order = np.argsort(seeds_, kind="stable")
    return np.searchsorted(seeds_[order], np.arange(len(block.pairs) + 1)), places_[order]


def find_pairs(ids: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(place, number) of the block's pairs in a document."""
    at, codes = _close(ids, len(block.vocabulary))
    if not len(at) or not len(block.pairs):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    number = np.minimum(np.searchsorted(block.pairs, codes), len(block.pairs) - 1)
    known = block.pairs[number] == codes
    return at[known], number[known]


def _spread(first: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the key, value) for every value of every key."""
    n = first[keys + 1] - first[keys]
    return np.repeat(np.arange(len(keys)), n), values[np.arange(n.sum()) + np.repeat(first[keys] - np.cumsum(n) + n, n)]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, start, end) with the place in the passage. Each row of
    the Smith-Waterman matrix is one vectorised step; a running maximum does the gaps
    along the row. Ties: the earliest end."""
    m = len(passage)
    slope = np.arange(m + 1) * GAP
    rows = [np.zeros(m + 1, np.int64)]
    for word in item:
        above, row = rows[-1], np.zeros(m + 1, np.int64)
        row[1:] = np.maximum(0, np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] + GAP))
        rows.append(np.maximum.accumulate(row - slope) + slope)
    h = np.stack(rows)
    i, j = np.unravel_index(np.argmax(h.T), h.T.shape)[::-1]
    best, end = int(h[i, j]), int(j)
    while i and j and h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + (MATCH if passage[j - 1] == item[i - 1] else MISMATCH):
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return best, int(j), end


def _blocks(benchmark: DataFrame, min_item_words: int, block_words: int, similarity: float, passage: int) -> Iterator[Block]:
    held, short, size = [], {}, 0
    for r in benchmark.where("item_id IS NOT NULL").select("item_id", "text").toLocalIterator():
        words = words_of(r["text"] or "")
        if not words:
            continue
        if size and size + len(words) > block_words:
            yield build_block(sorted(held), similarity, passage, short)
            held, short, size = [], {}, 0
        if len(words) < min_item_words:
            short.setdefault(tuple(words), []).append(r["item_id"])
        else:
            held.append((r["item_id"], words))
        size += len(words)
    if size:
        yield build_block(sorted(held), similarity, passage, short)


def _stretches(ids: np.ndarray, block: Block, rare: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(item, first, last pair) of each stretch of a document where an item that a rare seed
    joins has as many pairs as its least alignment, close enough together."""
    at, number = find_pairs(ids, block)
    if not len(at):
        return
    joined = np.zeros(len(block.words), bool)
    joined[_spread(*rare, np.unique(number))[1]] = True
    if not joined.any():
        return
    which, item = _spread(block.first, block.items_of, number)
    which, item = which[joined[item]], item[joined[item]]
    spot = np.unique(item * (len(ids) + 1) + at[which])         # by item, then by place, each place once
    item, at = spot // (len(ids) + 1), spot % (len(ids) + 1)
    k = least_pairs(block.need)[item]
    sizes = np.array([len(w) for w in block.words])
    span = 3 * sizes[item] - block.need[item]                   # words of the longest alignment
    end = np.arange(len(item)) + k - 1
    full = end < len(item)
    full[full] = (item[end[full]] == item[full]) & (at[end[full]] - at[full] <= span[full])
    cover = np.zeros(len(item) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(full), 1)
    np.add.at(cover, end[full] + 1, -1)
    good = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    if not len(good):
        return
    item, at, span = item[good], at[good], span[good]
    new = np.flatnonzero((item[1:] != item[:-1]) | (np.diff(at) > span[1:])) + 1
    begin, last = np.concatenate(([0], new)), np.append(new, len(item)) - 1
    yield from zip(item[begin].tolist(), at[begin].tolist(), at[last].tolist())


def _in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def within_reach(passage: np.ndarray, words: np.ndarray, pairs: np.ndarray, base: int, need: int) -> list[tuple[int, int]]:
    """Parts of a passage that hold all alignments of score ``need`` or more with the item of
    these words and pairs (codes first word * base + second).

    No alignment of passage[a:b] scores more than the sum over its words of 2 for a word
    of the item and -1 for another, less 1 for each two neighbours that are words of the
    item but no pair of it: these two cost a gap in the item or a mismatch."""
    known = _in(words, passage)
    worth = np.where(known, MATCH, MISMATCH)
    worth[1:] -= known[1:] & known[:-1] & ~_in(pairs, passage[:-1] * base + passage[1:])
    total = np.concatenate(([0], np.cumsum(worth)))
    # a part may begin without the cost of its first pair: at most 1
    low = np.minimum.accumulate(total[:-1])
    high = np.maximum.accumulate(total[:0:-1])[::-1]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], high - low + 1 >= need, [False]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _passages(item: np.ndarray, near: np.ndarray, words: np.ndarray, pairs: np.ndarray, base: int,
              need: float) -> Iterator[tuple[int, int, int]]:
    """(score, start, end) of the best alignment, then of the best left and right of it, and
    so on, until none scores ``need``."""
    open_parts = [(0, len(near))]
    while open_parts:
        a, b = open_parts.pop()
        if a == b:
            continue
        for i, j in within_reach(near[a:b], words, pairs, base, need):
            score, start, end = align(item, near[a + i:a + j])
            if score >= need:
                yield score, a + i + start, a + i + end
                open_parts += [(a + i, a + i + start), (a + i + end, a + j)]


FOUND = "doc_id long, item_id long, similarity double, start int, end int"


def _documents_with(texts: DataFrame, block: Block) -> np.ndarray:
    """In how many documents each pair of the block stands: a number a pair, summed within
    each partition before it is exchanged."""
    def run(batches):
        get, total = block.vocabulary.get, np.zeros(len(block.pairs), np.int64)
        for b in batches:
            for raw in b.column(1):
                ids = np.array([get(w, -1) for w in words_of(raw.as_py().decode("utf-8", "replace"))], np.int64)
                total[np.unique(find_pairs(ids, block)[1])] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    rows = texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(block.pairs), np.int64)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out


def _find(texts: DataFrame, block: Block) -> DataFrame:
    """The findings of one block."""
    rare = rare_pairs(block, _documents_with(texts, block))
    base = len(block.vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()),
                        ("start", pa.int32()), ("end", pa.int32())])
    words_in = [np.unique(w) for w in block.words]
    pairs_in = [np.unique(w[:-1] * base + w[1:]) for w in block.words]
    lengths: dict[str, set[int]] = {}
    for item in block.short:
        lengths.setdefault(item[0], set()).add(len(item))

    def copies(ids: np.ndarray):
        for k, first, last in _stretches(ids, block, rare):
            item = block.words[k]
            margin = 3 * len(item)
            at = max(first - margin, 0)
            near = ids[at:last + margin + 2]
            for score, start, end in _passages(item, near, words_in[k], pairs_in[k], base, int(block.need[k])):
                yield block.items[k], score / (MATCH * len(item)), at + start, at + end

    def exact(words: list[str]):
        for i, w in enumerate(words):
            for m in lengths.get(w, ()):
                for item in block.short.get(tuple(words[i:i + m]), ()) if i + m <= len(words) else ():
                    yield item, 1.0, i, i + m

    def run(batches):
        get = block.vocabulary.get
        for b in batches:
            out = []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(raw.as_py().decode("utf-8", "replace"))
                if block.words:
                    out += [(doc, *found) for found in copies(np.array([get(w, -1) for w in words], np.int64))]
                if lengths:
                    out += [(doc, *found) for found in exact(words)]
            if out:
                yield common.batch(schema, *zip(*out))

    return texts.mapInArrow(run, FOUND)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.6, passage: int = 24,
          min_item_words: int = 8, block_words: int = 500_000) -> DataFrame:
    """(doc_id, item_id, similarity, start, end) of every passage found: words start to end
    (exclusive) of the document align with the item, or are its words where it has fewer than
    ``min_item_words``. Null texts have no words; rows with a null doc_id can't be named and
    are left out, as are items without an id or words; repeated rows give repeated results.
    Empty tables give no rows. Other columns are not read."""
    spark = docs.sparkSession
    common.prepare(spark)
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", common.text_of("text").alias("text"))
    folder = f"{common.checkpoint_dir(spark).rstrip('/')}/leaks-{common.unique()}"
    spark.createDataFrame([], FOUND).write.parquet(folder)
    for block in _blocks(benchmark, min_item_words, block_words, similarity, passage):
        _find(texts, block).write.mode("append").parquet(folder)        # a block is let go before the next is read
    return spark.read.schema(FOUND).parquet(folder)


def judge(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, contaminated, item_id, similarity) of every row: the item that the document
    copies most closely (the smallest item_id on ties), else nulls. Other columns are not read."""
    best = leaks(docs, benchmark, **options).groupBy("doc_id") \
        .agg(F.min(F.struct((-F.col("similarity")).alias("s"), "item_id")).alias("best")) \
        .select(F.col("doc_id").alias("_doc"), "best")
    return docs.select("doc_id").join(best, F.col("doc_id") == F.col("_doc"), "left") \
               .select("doc_id", F.col("_doc").isNotNull().alias("contaminated"), F.col("best.item_id").alias("item_id"),
                       (-F.col("best.s")).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without a benchmark passage, with all their columns. Rows with a null
    doc_id can't be named by a finding and stay."""
    gone = common.cut(leaks(docs, benchmark, **options).select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
