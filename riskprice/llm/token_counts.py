"""Token counts of documents of any size.

The tokenizer drops white space and looks at nothing across it, so the counts of the parts
of a text between spaces add up. Ordinary documents are counted that way, behind a cache of
parts.

Huge documents are cut into overlapping chunks that are encoded one by one, on whatever
executor, with the offsets of their tokens. Two neighbours are spliced at a position of
their overlap that is

* proven stable: the tokenizer starts anew there whatever stands around it (``stable``);
* a boundary of both encodings: no token of either chunk reaches across it.

What stands behind that position in the left chunk and before it in the right one is
counted twice and taken off. Where an overlap has no such position, the document's chunks
and overlaps are widened fourfold and tried again; a document that never yields ends as one
chunk, which is exact.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import groups

# Where the tokenizer starts anew: before white space and around digits; and where a letter
# that has no other form is followed by a mark. Special strings are looked up before all else.
STABLE = re.compile(r"(?<=[^ \t\n\r])(?=[ \t\n\r])|(?<=[0-9])|(?=[0-9])"
                    r"|(?<=[A-Za-z一-鿿])(?=[!-/:-@\[-`{-~、。！，？])")
SPECIAL = re.compile(r"<\|[a-z]+\|>")
SHORTEST = 32           # overlap; a special string is shorter, so one of two neighbours has it whole


def stable(text: str) -> np.ndarray:
    """Positions of ``text`` at which its encoding can be cut: the tokens before do not
    depend on what follows, nor those behind on what precedes. Positions inside a special
    string don't count."""
    at = np.array([m.start() for m in STABLE.finditer(text)], np.int64)
    for m in SPECIAL.finditer(text):
        at = at[(at <= m.start()) | (at >= m.end())]
    return at


class Counter:
    """The tokenizers library with its defaults for special strings, without truncation,
    padding or added tokens. Parts between spaces are cached in two halves: a full recent
    half becomes the older one. Results do not depend on the cache."""

    def __init__(self, path: str, cache_size: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = cache_size // 2
        self.recent: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.recent) > self.size:
            self.recent, self.older = {}, self.recent
        recent, older = self.recent, self.older
        new = []
        for p in set().union(*parts).difference(recent):
            if (known := older.get(p)) is None:
                new.append(p)
            else:
                recent[p] = known
        recent.update(zip(new, map(len, self.library.encode_batch_fast(new, add_special_tokens=False))))
        out = [sum(map(recent.__getitem__, ps)) for ps in parts]
        for p in new:
            if len(p) > 64:                             # long parts hardly come back
                del recent[p]
        return out

    def marks(self, text: str, first: bool, last: bool, overlap: int) -> tuple[int, list, list]:
        """(tokens, boundaries in the overlap with the chunk before, those in the overlap
        with the chunk behind); a boundary is (position in the chunk, tokens before it)."""
        e = self.library.encode(text, add_special_tokens=False)
        starts, ends = np.array(e.offsets, np.int64).reshape(-1, 2).T

        def within(a: int, b: int) -> list:
            at = stable(text[max(a - 1, 0):b + 1]) + max(a - 1, 0)
            at = at[(at > a) & (at < b)]
            before = np.searchsorted(ends, at, "right")
            clear = np.append(starts, len(text))[before] >= at     # no token reaches across
            return list(zip(at[clear].tolist(), before[clear].tolist()))

        return (len(ends), [] if first else within(0, overlap), [] if last else within(len(text) - overlap, len(text)))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def spans(length: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of ``size`` characters that overlap by ``overlap``; the last may be shorter."""
    step = size - overlap
    n = max(1, -(-(length - overlap) // step))
    return [(i * step, min(i * step + size, length)) for i in range(n)]


CHUNKS = "doc_id long, key string, n_bytes long, chunk long, n_chunks long, start long, text string"
ENCODED = "doc_id long, key string, n_bytes long, chunk long, n_chunks long, n_tokens long, " \
          "marks array<struct<pair:long,pos:long,extra:long,side:int>>"


def _encode_chunks(big: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """Each chunk of the documents (doc_id, key, n_bytes, text) with its number of tokens
    and its boundaries: side 0 for the left chunk of a pair, with the tokens behind the
    position, side 1 for the right one, with those before it."""
    def cut(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for doc_id, key, n_bytes, text in zip(*(c.to_pylist() for c in b.columns)):
                chunks = spans(len(text), size, overlap)
                for i, (a, z) in enumerate(chunks):
                    yield pa.RecordBatch.from_pylist([dict(doc_id=doc_id, key=key, n_bytes=n_bytes, chunk=i, n_chunks=len(chunks),
                                                           start=a, text=text[a:z])], schema=chunk_schema)

    def run(batches: Iterator[pa.RecordBatch]):
        tokenizer = counter(path)
        for b in batches:
            for r in b.to_pylist():
                i, start = r["chunk"], r["start"]
                n, left, right = tokenizer.marks(r.pop("text"), i == 0, i == r["n_chunks"] - 1, overlap)
                del r["start"]
                marks = [dict(pair=i - 1, pos=start + p, extra=k, side=1) for p, k in left]
                marks += [dict(pair=i, pos=start + p, extra=n - k, side=0) for p, k in right]
                yield pa.RecordBatch.from_pylist([{**r, "n_tokens": n, "marks": marks}], schema=encoded_schema)

    chunk_schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("n_bytes", pa.int64()), ("chunk", pa.int64()),
                              ("n_chunks", pa.int64()), ("start", pa.int64()), ("text", pa.string())])
    mark = pa.struct([("pair", pa.int64()), ("pos", pa.int64()), ("extra", pa.int64()), ("side", pa.int32())])
    encoded_schema = pa.schema([*list(chunk_schema)[:5], ("n_tokens", pa.int64()), ("marks", pa.list_(mark))])
    return big.mapInArrow(cut, CHUNKS).repartition("key", "chunk").mapInArrow(run, ENCODED)


def _splice(encoded: DataFrame) -> DataFrame:
    """(doc_id, key, n_bytes, n_tokens, copies, whole) of each document; whole is false
    where a pair of neighbours has no common boundary."""
    doc = ["doc_id", "key"]
    chunks = encoded.groupBy(*doc, "chunk").agg(F.max("n_tokens").alias("n"), F.max("n_chunks").alias("n_chunks"),
                                                F.max("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("copies"))
    m = encoded.select(*doc, F.explode("marks").alias("m")).select(*doc, "m.*")
    twice = m.groupBy(*doc, "pair", "pos").agg(F.max(F.expr("IF(side = 0, extra, NULL)")).alias("a"),
                                               F.max(F.expr("IF(side = 1, extra, NULL)")).alias("b")) \
             .where("a IS NOT NULL AND b IS NOT NULL") \
             .groupBy(*doc, "pair").agg(F.min_by(F.col("a") + F.col("b"), "pos").alias("n"))
    zero = F.lit(0).cast("long")
    rows = chunks.select(*doc, "n", zero.alias("pairs"), "n_chunks", "n_bytes", "copies").unionByName(
        twice.select(*doc, (-F.col("n")).alias("n"), F.lit(1).cast("long").alias("pairs"), zero.alias("n_chunks"),
                     zero.alias("n_bytes"), zero.alias("copies")))
    return rows.groupBy(*doc).agg(F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"), F.max("copies").alias("copies"),
                                  (F.sum("pairs") == F.max("n_chunks") - 1).alias("whole"))


def count(docs: DataFrame, tokenizer_path: str, limit: int = 2_048, chunk: int = 65_536, overlap: int = 1_024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row: the tokens of the whole text.

    Texts of more than ``chunk`` characters are counted in chunks. Null text: empty, no
    tokens. Null and repeated ids stay as often as they come; an empty table gives no
    rows. Other columns are not read."""
    common.prepare(docs.sparkSession)
    if not SHORTEST <= overlap <= chunk // 2:
        raise ValueError(f"an overlap has {SHORTEST} characters at least and half a chunk at most")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        tokenizer = counter(tokenizer_path)
        for b in batches:
            n = [k for raws in groups(t.as_py() for t in b.column(2))
                 for k in tokenizer.counts([r.decode("utf-8", "replace") for r in raws])]
            yield common.batch(schema, b.column(0), b.column(1), n)

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    huge = F.length("text") > chunk
    out = rows.where(~huge).select("doc_id", "n_bytes", F.col("text").cast("binary").alias("text")) \
              .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    left = rows.where(huge).select("doc_id", F.sha2("text", 256).alias("key"), "n_bytes", "text")
    size, shared = chunk, overlap
    while True:
        encoded = common.cut(_encode_chunks(left, tokenizer_path, size, shared))
        found = common.cut(_splice(encoded))
        out = out.unionByName(found.where("whole").select("doc_id", "n_bytes", "n_tokens",
                                                          F.expr("explode(array_repeat(0, int(copies)))").alias("_copy")).drop("_copy"))
        failed = found.where("NOT whole").select("doc_id", "key")
        if failed.isEmpty():
            break
        left = left.join(failed.select("key").distinct(), "key", "left_semi").select("doc_id", "key", "n_bytes", "text")
        size, shared = size * 4, shared * 4
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
