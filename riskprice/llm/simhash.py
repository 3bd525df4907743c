"""SimHash near-duplicates: 64-bit fingerprints linked at a few differing bits.

Fingerprints: numpy inside Arrow batches, one pass over the whole texts. Linking works
on *distinct* fingerprints (equal ones are one node, whatever their number):

1. **Pivot table.** Once for each distinct fingerprint, its Hamming distances to 16 fixed
   reference fingerprints. Distances to a reference point differ by no more than the
   fingerprints themselves do.
2. **Pre-deal.** Distances alone can't deal 64-bit codes out over a cluster: a coordinate
   tells apart only about half of all unrelated pairs, so 2^c probes of c coordinates meet
   (3/4)^c of all rows. Hence five bit blocks: two fingerprints that differ in at most three
   bits agree on at least two, so each fingerprint is dealt under its ten pairs of blocks.
3. **Discarding.** In every bucket, however small, pairs are swept in the order of the
   first coordinate and go where any of the 16 coordinates differs by more than the limit.
4. **Verification.** The survivors' bits are compared exactly, so links are exact.

A bucket gives only a spanning forest of its links, never all pairs. A bucket of more
than ``BUCKET`` distinct fingerprints is cut into chunks, and each pair of chunks is a
bucket of its own, so no task gathers a large group; n fingerprints of one bucket are then
copied n / ``BUCKET`` times each. Components come from alternating star rounds over the edges.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42                       # of XXH64, as Spark's xxhash64()
BLOCKS = (0, 13, 26, 39, 52, 64)            # bit blocks: any two of the five agree
BUCKET = 2048                   # distinct fingerprints that one comparison task holds twice at most
PIVOTS = np.random.default_rng(20_240_501).integers(0, 2**64, 16, dtype=np.uint64)
PAIRS = 1 << 20                 # pairs that are compared at a time


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """Fingerprint of one UTF-8 text; no words: zero."""
    import xxhash
    words = raw.lower().split()             # bytes: lower-cases A-Z only, splits at \x20 and \x09-\x0D
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n]
    stops = ends[min(shingle, len(words)) - 1:] - 1
    hash64 = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):         # bounded scratch memory for very long texts
        a, b = starts[at:at + (1 << 14)].tolist(), stops[at:at + (1 << 14)].tolist()
        h = np.fromiter((hash64(text[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp: the fingerprint's bits as a signed long) of every row."""
    common.prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield common.batch(schema, b.column(0), common.signed(fp))

    return docs.select("doc_id", common.text_of("text").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _block_keys(max_bits: int):
    """One column per choice of blocks: the bits of those blocks, and which choice it is."""
    if max_bits > 3:
        raise ValueError("five blocks propose pairs of up to three differing bits")
    keys = []
    for k, blocks in enumerate(combinations(range(5), 2)):
        mask = sum(((1 << (BLOCKS[i + 1] - BLOCKS[i])) - 1) << BLOCKS[i] for i in blocks)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask)), F.lit(k)))
    return F.array(*keys)


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to the reference fingerprints; (rows, 16) of int8."""
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def with_pivots(distinct: DataFrame) -> DataFrame:
    """(node, fp, p0, p1): the pivot table's row of each fingerprint, packed into two longs."""
    common.prepare(distinct.sparkSession)
    schema = pa.schema([(c, pa.int64()) for c in ("node", "fp", "p0", "p1")])

    def run(batches):
        for b in batches:
            packed = pivot_table(b.column(1).to_numpy().view(np.uint64)).view(np.int64)
            yield common.batch(schema, b.column(0), b.column(1), packed[:, 0], packed[:, 1])

    return distinct.select("node", "fp").mapInArrow(run, "node long, fp long, p0 long, p1 long")


def forest(fp: np.ndarray, side: np.ndarray | None, max_bits: int, bucket: np.ndarray | None = None,
           table: np.ndarray | None = None, counts: dict | None = None) -> list[tuple[int, int]]:
    """Spanning forests (index pairs) of the links within each bucket (all in one without
    ``bucket``). ``side``: 0, or with two chunks 1 and 2, of which only pairs across count
    (pairs within are another task's). ``counts`` receives the numbers of pairs in the
    buckets, swept, verified and linked."""
    side = np.zeros(len(fp), np.int8) if side is None else side
    bucket = np.zeros(len(fp), np.int64) if bucket is None else bucket
    table = pivot_table(fp) if table is None else table
    order = np.lexsort((table[:, 0], bucket))
    bucket, fp, table, side = bucket[order], fp[order], table[order], side[order]
    # bucket and first coordinate in one number: coordinates are at most 64, so a reach never leaves its bucket
    place = np.cumsum(np.concatenate(([0], bucket[1:] != bucket[:-1]))) * 256 + table[:, 0]
    last = np.searchsorted(place, place + max_bits, side="right")
    n = last - np.arange(len(place)) - 1                    # candidates after each row
    if counts is not None:
        sizes = np.bincount(place // 256).astype(np.int64)
        counts["pairs"] = counts.get("pairs", 0) + int((sizes * (sizes - 1) // 2).sum())
        counts["swept"] = counts.get("swept", 0) + int(n.sum())
    parent = np.arange(len(fp))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    total = np.cumsum(n)
    at = 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        i = np.repeat(np.arange(at, end), n[at:end])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n[at:end]) - n[at:end], n[at:end])
        at = end
        across = (side[i] == 0) | (side[i] != side[j])
        i, j = i[across], j[across]
        for part in (slice(1, 5), slice(5, 16)):            # the maximum coordinate difference discards
            near = np.abs(table[i, part] - table[j, part]).max(axis=1, initial=0) <= max_bits
            i, j = i[near], j[near]
        linked = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
        if counts is not None:
            counts["verified"] = counts.get("verified", 0) + len(i)
            counts["linked"] = counts.get("linked", 0) + int(linked.sum())
        i, j = i[linked], j[linked]
        roots = parent.copy()
        while (up := roots[roots] != roots).any():
            roots = np.where(up, roots[roots], roots)
        apart = roots[i] != roots[j]                        # what is connected already adds nothing
        for x, y in zip(i[apart].tolist(), j[apart].tolist()):
            u, v = find(x), find(y)
            if u != v:
                parent[max(u, v)] = min(u, v)
                edges.append((int(order[x]), int(order[y])))
    return edges


def links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges (a, b: node ids) that connect what the fingerprints within ``max_bits``
    connect. ``distinct``: (node, fp: long), each fingerprint once, with its pivots or not."""
    if "p0" not in distinct.columns:
        distinct = common.cut(with_pivots(distinct))
    own = ("node", "fp", "p0", "p1")
    dealt = distinct.select(*own, F.explode(_block_keys(max_bits)).alias("key"))
    big = distinct.select(F.explode(_block_keys(max_bits)).alias("key")) \
                  .groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET) \
                  .select("key", F.ceil(F.col("n") / BUCKET).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    dealt = dealt.join(big, "key", "left").withColumn("chunk", F.when(F.col("chunks").isNull(), 0).otherwise(chunk))
    partner = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0)))
                        .otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("key", *own, "chunk", partner.alias("other")) \
                 .select(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"),
                         *own, F.when(F.col("chunk") == F.col("other"), 0).when(F.col("chunk") < F.col("other"), 1)
                         .otherwise(2).cast("byte").alias("side"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held = None                          # rows of the last, perhaps unfinished, bucket
        for b in batches:
            t = pa.Table.from_batches([b])
            rows = [t.column(i).to_numpy() for i in range(6)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            cuts = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            held = [x[last:] for x in rows]
            yield from edges_of([x[:last] for x in rows])
        if held is not None:
            yield from edges_of(held)

    def edges_of(rows):
        key, node, fp, p0, p1, side = rows
        several = np.zeros(len(key), bool)
        several[1:] = key[1:] == key[:-1]
        several[:-1] |= several[1:]          # rows that are not alone in their bucket
        key, node, fp, p0, p1, side = (x[several] for x in rows)
        if len(key):
            found = forest(fp.view(np.uint64), side, max_bits, key, np.stack([p0, p1], axis=1).view(np.int8))
            if found:
                a, b = np.array(found).T
                yield common.batch(schema, node[a], node[b])

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def components(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of at
    most ``max_bits`` differing bits can reach, the row's own included.

    Null or empty text: fingerprint zero, linked like any other. Rows with a null doc_id
    keep their fingerprint and link nothing; their component_id is null. Repeated rows
    have equal results; a doc_id that comes with several texts links by each of its rows.
    An empty table gives no rows. Other columns are not read."""
    fp = common.cut(fingerprints(docs, shingle))
    distinct = common.cut(with_pivots(fp.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"))))
    grouped = common.connected_components(links(distinct, max_bits))
    found = distinct.join(grouped, "node", "left") \
                    .select(F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("_component"))
    found = fp.join(found, fp["fp"] == found["_fp"], "left")
    return found.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("_component")).alias("component_id"))


def fingerprint_hex(column: str = "fp"):
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One document of each group stays: the one whose doc_id is the smallest. All
    columns are kept. Rows with a null doc_id can't be named by a group and stay; of
    repeated rows of one doc_id, one stays."""
    found = common.cut(components(docs, shingle, max_bits).where("doc_id IS NOT NULL").groupBy("doc_id")
                       .agg(F.min("component_id").alias("_component"), F.count(F.lit(1)).alias("_rows")))
    gone = found.where(F.col("_component") != F.col("doc_id")).select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("_rows > 1 AND doc_id = _component").select("doc_id")
    if not repeated.limit(1).count():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
