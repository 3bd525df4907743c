"""Token ids as flat binary files.

Format: a folder with, for each partition,

* ``<name>.tokens``   ids as little-endian unsigned integers, documents end to end
  (16 bits where every id fits, else 32 bits; the manifest says which);
* ``<name>.offsets``  64-bit unsigned: position of each document's first id within the
  file, and at the end the number of ids;
* ``<name>.docs``     64-bit signed document ids.

Partitions are ranges of doc_id in ascending order, documents ascend within each. The
manifest (one row a partition) carries the partitions' bases: prefix sums of the ids of
all partitions before, so a document's place in the whole corpus is base + offset.

A retried task writes under a new name, and only files of finished tasks are in the
manifest, so a lost executor leaves no damage. The folder must be shared (it is taken
from ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os
import re
import uuid
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import groups

# A text is cut before white space that follows something else: byte-level BPE never
# merges across such a place, and what stands before it never depends on what follows.
PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z")
# Other white space could join a run across a cut: such texts are encoded in one piece.
OTHER_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


# An added token's string, and what makes a text uneven: neighbouring, leading or trailing
# white space, white space other than spaces and line feeds, added tokens, no text at all.
SPECIAL = re.compile(r"<\|")
UNEVEN = (r"\A\z|[ \n][ \n]|\A[ \n]|[ \n]\z|<\||[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
          r"\x{202f}\x{205f}\x{3000}]")


class LibraryEncoder:
    """The tokenizers library, as it is by default, behind a cache of pieces. The cache has a
    recent and an older half; a full recent half becomes the older one, so frequent pieces
    stay. Results do not depend on it. A text with an added token's string, or with other
    white space, goes to the library in one piece."""

    def __init__(self, path: str, cache_size: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        if sys.byteorder != "little":
            raise RuntimeError("the files are little-endian")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        if any(not OTHER_SPACE.search(a) and not SPECIAL.search(a) for a in self.added):
            raise ValueError("an added token is not told by its marks")
        vocabulary = self.library.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)     # bytes of each token
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)                # byte-level: a character for each byte
        self.size = cache_size // 2
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of the file's integer type."""
        if len(self.recent) > self.size:
            self.recent, self.older = {}, self.recent
        column = pa.array(texts, pa.large_string())
        plain = pc.invert(pc.match_substring_regex(column, UNEVEN)).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(np.flatnonzero(plain).tolist(), self._even(column.filter(pa.array(plain)))):
            out[i] = ids
        for i in np.flatnonzero(~plain).tolist():
            out[i] = self._uneven(texts[i])
        return out

    def _even(self, column: pa.Array) -> Iterator[bytes]:
        """Texts whose white space is single spaces and line feeds between words: cut, told
        apart and put together again column by column."""
        if not len(column):
            return
        parts = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        first = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        words = parts.flatten().dictionary_encode()
        place, different = words.indices.to_numpy(), words.dictionary.to_pylist()
        # a word has the space before it that it was cut at, unless a line feed or nothing is there
        pieces = [w if w[:1] == "\n" else " " + w for w in different]
        beginnings = [different[i] for i in place[first].tolist()]
        ids = self._lookup([*pieces, *beginnings])
        pool = np.frombuffer(b"".join(ids), self.dtype)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        place = place.astype(np.int64)
        place[first] = np.arange(len(pieces), len(ids))
        n = sizes[place]
        ends = np.cumsum(n)
        data = pool[np.repeat(starts[place] - ends + n, n) + np.arange(n.sum())].tobytes()
        bounds = (np.append((ends - n)[first], ends[-1]) * self.dtype.itemsize).tolist()
        yield from (data[i:j] for i, j in zip(bounds, bounds[1:]))

    def _uneven(self, text: str) -> bytes:
        """A text with other or more white space, or with an added token's string."""
        if OTHER_SPACE.search(text) or any(a in text for a in self.added):
            return self._by_library([text])[0]
        return b"".join(self._lookup(PIECE.findall(text)))

    def _lookup(self, pieces: list[str]) -> list[bytes]:
        recent, older = self.recent, self.older
        missing = set(pieces).difference(recent)
        known = missing.intersection(older)
        recent.update(zip(known, map(older.__getitem__, known)))
        new = list(missing.difference(known))
        self._add_new(new)
        out = list(map(recent.__getitem__, pieces))
        for piece in new:
            if len(piece) > 64:                         # long pieces hardly come back
                del recent[piece]
        return out

    def _by_library(self, texts: list[str]) -> list[bytes]:
        return [array(self.dtype.char, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _add_new(self, pieces: list[str], together: int = 512) -> None:
        """Ids of pieces. Those with white space only before something else can be laid end
        to end, which spares the library a call for each; the ids are told apart by their
        lengths in bytes."""
        recent, size = self.recent, self.dtype.itemsize
        joinable = [p for p in pieces if p[:1] in (" ", "\n") and p[-1] not in " \n"]
        rest = list(set(pieces).difference(joinable))
        recent.update(zip(rest, self._by_library(rest)))
        rows = [joinable[i:i + together] for i in range(0, len(joinable), together)]
        joined = ["".join(r) for r in rows]
        for row, text, e in zip(rows, joined, self.library.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            ends = np.cumsum(list(map(len, row if text.isascii() else [p.encode("utf-8") for p in row])))
            cuts = ((np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1) * size).tolist()
            data = ids.tobytes()
            recent.update(zip(row, [data[i:j] for i, j in zip([0, *cuts], cuts)]))


TOGETHER = 1 << 22      # bytes of text whose pieces are looked up at a time
_ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def _filesystem(folder: str):
    """(file system, path) of a folder named by URI or plain path."""
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _open(filesystem, path: str):
    return pa.memory_map(path) if isinstance(filesystem, fs.LocalFileSystem) else filesystem.open_input_file(path)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None,
                      partitions: int | None = None) -> list[dict]:
    """Encode every whole text, append ``end_id`` to each document, write the files and
    return the manifest (one small row a partition, in order).

    Null text: empty. Null doc_ids come first (the manifest counts them); repeated ids
    stay as often as they come, ordered by a hash of their text. An empty table gives
    files without documents or none. Other columns are not read."""
    spark = docs.sparkSession
    common.prepare(spark)
    folder = f"{(folder or common.checkpoint_dir(spark)).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    filesystem, path = _filesystem(folder)
    filesystem.create_dir(path, recursive=True)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("part", pa.int32()), ("name", pa.string()), ("itemsize", pa.int32()), ("null_ids", pa.int64()),
                        ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        enc = library_encoder(tokenizer_path)
        context = TaskContext.get()
        part = context.partitionId()
        name = f"{folder}/part-{part:05d}-{context.taskAttemptId()}"
        filesystem, path = _filesystem(name)
        end = np.array([end_id], enc.dtype).tobytes()
        at = n_docs = nulls = 0
        with filesystem.open_output_stream(path + ".tokens") as tokens, \
                filesystem.open_output_stream(path + ".offsets") as offsets, \
                filesystem.open_output_stream(path + ".docs") as ids:
            for b in batches:
                ids.write(b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                nulls += b.column(0).null_count
                for raws in groups((t.as_py() for t in b.column(1)), TOGETHER):
                    encoded = [e + end for e in enc.encode([r.decode("utf-8") for r in raws])]
                    sizes = np.array([len(e) for e in encoded], np.int64) // enc.dtype.itemsize
                    ends = at + np.cumsum(sizes)
                    offsets.write((ends - sizes).astype("<u8").tobytes())
                    tokens.write(b"".join(encoded))
                    at, n_docs = int(ends[-1]), n_docs + len(raws)
            offsets.write(np.array([at], "<u8").tobytes())
        yield common.batch(schema, [part], [name], [enc.dtype.itemsize], [nulls], [n_docs], [at])

    rows = (docs.select(F.col("doc_id"), common.text_of("text").alias("text"))
                .repartitionByRange(n, F.col("doc_id").asc_nulls_first())
                .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
                .mapInArrow(run, "part int, name string, itemsize int, null_ids long, n_docs long, n_tokens long")
                .collect())                              # one row a partition
    rows = sorted((r.asDict() for r in rows), key=lambda r: r["part"])
    for r, base in zip(rows, accumulate((r["n_tokens"] for r in rows), initial=0)):
        r["base"] = base
    return rows


def read_token_files(spark: SparkSession, manifest: list[dict], chunk: int = 1024) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files through
    memory maps: start counts the ids of all documents before it, n_tokens includes the
    end id, ids_crc32 is taken over the ids as little-endian unsigned 32-bit integers."""
    common.prepare(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for r in b.to_pylist():
                filesystem, path = _filesystem(r["name"])
                dtype = np.dtype(f"<u{r['itemsize']}")
                with _open(filesystem, path + ".offsets") as offsets, _open(filesystem, path + ".docs") as ids:
                    tokens = _open(filesystem, path + ".tokens") if r["n_tokens"] else None
                    for at in range(0, r["n_docs"], chunk):
                        m = min(chunk, r["n_docs"] - at)
                        o = np.frombuffer(offsets.read_at((m + 1) * 8, at * 8), "<u8").astype(np.int64)
                        doc = np.frombuffer(ids.read_at(m * 8, at * 8), "<i8")
                        crc = []
                        for i, j in zip(o[:-1].tolist(), o[1:].tolist()):
                            got = np.frombuffer(tokens.read_at((j - i) * dtype.itemsize, i * dtype.itemsize), dtype)
                            crc.append(zlib.crc32(got.astype("<u4").tobytes()))
                        null = np.arange(at, at + m) < r["null_ids"]
                        yield common.batch(schema, pa.array(doc, pa.int64(), mask=null), r["base"] + o[:-1], np.diff(o), crc)

    ddl = "part int, name string, itemsize int, null_ids long, n_docs long, n_tokens long, base long"
    columns = [c.split()[0] for c in ddl.split(", ")]
    files = [tuple(r[c] for c in columns) for r in manifest if r["n_docs"]]
    return spark.createDataFrame(files, ddl).repartition(max(1, len(files))) \
                .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
