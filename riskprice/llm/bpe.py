"""Byte-level BPE encoding and decoding without a regular expression.

Pre-tokenisation is vectorised over a whole batch of texts:

1. the texts are laid end to end as one array of code points, and a table over all code
   points gives the class of each;
2. a finite-state machine recognises contractions ('s, 're, ...). Each class is a
   function from state to state; the functions reachable by composition form a small
   monoid, so a prefix is one small integer and the composition of two prefixes is one
   table lookup. That operation is associative, and a blocked scan applies it to all
   characters at once (a text's first character carries a constant function, so texts
   do not see each other);
3. all other boundaries follow from the classes of a character and its neighbours.

The slices feed pair merging by rank through a cache, and the boundaries are kept as
byte offsets (``n_pieces``; ``encode_batch`` returns them), so that any token range can
be decoded to its place in the text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# FIXED VALUES: code points with the Unicode property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# FIXED VALUES: contraction endings of the pattern, by the character after the apostrophe.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = {"r": "e", "v": "e", "l": "l"}
# FIXED VALUES: letters and numbers that came with Unicode 16 (first, last), which older
# character databases list as unassigned.
LETTERS_16 = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
              (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
              (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
              (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
              (0x1E5F0, 0x1E5F0))
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
              (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# end of fixed values

# classes of code points; LETTER and above are letters
SPACE_OTHER, SPACE, NUMBER, OTHER, APOSTROPHE, LETTER, STMD, R_OR_V, L, E = range(10)
START = 10                                  # class offset of a text's first character
# kinds that a run is made of
KIND = np.array([0, 0, 1, 2, 2, 3, 3, 3, 3, 3], np.uint8)

# states: what the characters so far allow
CLOSED, OPEN, AFTER_APOSTROPHE, WANTS_E, WANTS_L, DONE = range(6)


def _step(state: int, cls: int) -> int:
    if cls in (SPACE, OTHER):
        return CLOSED                        # an apostrophe next joins this run or space
    if cls in (SPACE_OTHER, NUMBER):
        return OPEN
    if cls == APOSTROPHE:
        return AFTER_APOSTROPHE if state in (OPEN, WANTS_E, WANTS_L, DONE) else CLOSED
    if state == AFTER_APOSTROPHE:
        return {STMD: DONE, R_OR_V: WANTS_E, L: WANTS_L}.get(cls, OPEN)
    if (state, cls) in ((WANTS_E, E), (WANTS_L, L)):
        return DONE
    return OPEN


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    t = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for kind, ranges in ((LETTER, LETTERS_16), (NUMBER, NUMBERS_16)):
        for a, b in ranges:
            t[a:b + 1] = kind
    t[list(WHITE_SPACE)] = SPACE_OTHER
    t[32], t[39] = SPACE, APOSTROPHE
    t[[ord(c) for c in SHORT_ENDINGS]] = STMD
    t[[ord("r"), ord("v")]] = R_OR_V
    t[ord("l")], t[ord("e")] = L, E
    return t


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(function id of each class, composition table, final state by function id).

    Ids 0-9 are the classes, 10-19 the same classes at a text's start: constant
    functions, as no state comes in. ``compose[f, g]`` is "f, then g"."""
    fs = [tuple(_step(s, c) for s in range(6)) for c in range(10)]
    fs += [(_step(OPEN, c),) * 6 for c in range(10)]
    ids: dict[tuple, int] = {}
    of_class = [ids.setdefault(f, len(ids)) for f in fs]
    todo = list(ids)
    while todo:                              # closure under composition with a generator
        f = todo.pop()
        for g in set(fs):
            h = tuple(g[s] for s in f)
            if h not in ids:
                ids[h] = len(ids)
                todo.append(h)
    all_f = list(ids)
    compose = np.array([[ids[tuple(g[s] for s in f)] for g in all_f] for f in all_f], np.uint8)
    return np.array(of_class, np.uint8), compose, np.array([f[OPEN] for f in all_f], np.uint8)


def scan(f: np.ndarray, compose: np.ndarray, block: int = 128) -> np.ndarray:
    """Inclusive prefix compositions of the functions ``f``: scans in blocks, all blocks
    side by side, then the scan of the blocks' totals is put before each block."""
    n = len(f)
    if n <= block:
        out = f.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], out[i]]
        return out
    blocks = -(-n // block)
    grid = np.zeros(blocks * block, np.uint8)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(blocks, block).T)
    flat, width = compose.ravel(), len(compose)
    for j in range(1, block):
        grid[j] = flat[grid[j - 1].astype(np.intp) * width + grid[j]]
    before = scan(grid[-1], compose, block)[:-1]
    grid[:, 1:] = flat[before.astype(np.intp)[None, :] * width + grid[:, 1:]]
    return np.ascontiguousarray(grid.T).ravel()[:n]


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """True where a piece begins. ``points``: code points of texts laid end to end;
    ``starts``: positions of the texts' first characters (texts are not empty)."""
    n = len(points)
    if not n:
        return np.empty(0, bool)
    cls = class_table()[points]
    first = np.zeros(n, bool)
    first[starts] = True
    of_class, compose, final = monoid()
    state = final[scan(of_class[cls + START * first.astype(np.uint8)], compose)]
    kind = KIND[cls]
    white = kind == 0
    same = np.zeros(n, bool)
    same[1:] = kind[1:] == kind[:-1]
    after_space = np.zeros(n, bool)
    after_space[1:] = cls[:-1] == SPACE
    last_white = np.zeros(n, bool)           # white space right before something else in its text
    last_white[:-1] = white[:-1] & ~white[1:] & ~first[1:]
    begin = np.where(white, ~same | last_white, ~same & ~after_space)
    done = np.flatnonzero(state == DONE)     # last characters of contractions
    long = (cls[done - 1] == R_OR_V) & (cls[done] == E) | (cls[done - 1] == L) & (cls[done] == L)
    long &= cls[np.maximum(done - 2, 0)] == APOSTROPHE
    long &= state[done - 1] != DONE
    begin[done] = False
    begin[done[long] - 1] = False
    after = done + 1
    begin[after[after < n]] |= ~white[after[after < n]]
    begin[first] = True
    return begin


class Encoder:
    """Merges by rank, with a cache of pieces (it is emptied when full; results do not
    depend on it)."""

    def __init__(self, ranks: dict[bytes, int], cache_size: int = 400_000):
        self.ranks, self.size = ranks, cache_size
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost on ties, until no adjacent pair has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        if len(piece) <= 24:
            parts = [piece[i:i + 1] for i in range(len(piece))]
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = ranks.get(parts[i] + parts[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            return tuple(ranks[p] for p in parts)
        # long pieces: a heap of pairs over a linked list, n log n in all
        n = len(piece)
        end = list(range(1, n + 1))          # end of the part that starts here; 0: swallowed
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            m = end[i]
            if not m or m >= n or m >= j or end[m] != j:
                continue                     # one of the two parts has changed since
            end[i], end[m] = j, 0
            if j < n:
                prev[j] = i
                if (r := ranks.get(piece[i:end[j]])) is not None:
                    heapq.heappush(heap, (r, i, end[j]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:j])) is not None:
                heapq.heappush(heap, (r, p, j))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return tuple(out)

    def ids(self, piece: bytes) -> tuple[int, ...]:
        got = self.cache.get(piece)
        if got is None:
            got = self.merge(piece)
            if len(self.cache) >= self.size:
                self.cache.clear()
            if len(piece) <= 64:
                self.cache[piece] = got
        return got

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(load_ranks(path))
    return _ENCODERS[path]


def piece_offsets(raws: list[bytes]) -> list[list[int]]:
    """Byte offsets at which the pieces of each UTF-8 text begin, and its length."""
    full = [r for r in raws if r]
    if not full:
        return [[0] for _ in raws]
    data = b"".join(full)
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)   # byte of each code point
    ends = np.cumsum([len(r) for r in full])
    begins = ends - [len(r) for r in full]
    at = lead[boundaries(points, np.searchsorted(lead, begins))]
    cuts = np.split(at, np.searchsorted(at, begins[1:]))
    done = iter([(c - b).tolist() + [int(e - b)] for c, b, e in zip(cuts, begins.tolist(), ends.tolist())])
    return [next(done) if r else [0] for r in raws]


def groups(raws: Iterable[bytes], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts in order, in lists of about ``limit`` bytes (a longer text is alone)."""
    held, size = [], 0
    for r in raws:
        if held and size + len(r) > limit:
            yield held
            held, size = [], 0
        held.append(r)
        size += len(r)
    if held:
        yield held


def encode_batch(raws: list[bytes], enc: Encoder) -> Iterator[tuple[list[tuple[int, ...]], list[int]]]:
    """For each text: the ids of each piece, and the pieces' byte offsets."""
    for part in groups(raws):
        for raw, offsets in zip(part, piece_offsets(part)):
            yield [enc.ids(raw[a:b]) for a, b in zip(offsets, offsets[1:])], offsets


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_pieces, token_ids, decoded): ids of every whole text and the bytes
    decoded from them. Null and empty texts have no ids; rows with null or repeated
    doc_id are encoded like any other; other columns are not read."""
    return _encode(docs, ranks_path, id_col, text_col, digests=False)


def encode_digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_pieces): the same encoding and
    decoding, with digests in place of the ids and bytes."""
    return _encode(docs, ranks_path, id_col, text_col, digests=True)


def _encode(docs, ranks_path, id_col, text_col, digests):
    common.prepare(docs.sparkSession)
    if digests:
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                            ("decoded_sha256", pa.string()), ("n_pieces", pa.int64())])
        ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pieces long"
    else:
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_pieces", pa.int64()),
                            ("token_ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
        ddl = "doc_id long, n_tokens long, n_pieces long, token_ids array<int>, decoded binary"

    def run(batches):
        enc = encoder(ranks_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for doc, (pieces, offsets) in zip(part.column(0).to_pylist(), encode_batch(part.column(1).to_pylist(), enc)):
                    ids = [i for p in pieces for i in p]
                    decoded = enc.decode(ids)
                    if digests:
                        rows.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                                     hashlib.sha256(decoded).hexdigest(), len(offsets) - 1))
                    else:
                        rows.append((doc, len(ids), len(offsets) - 1, ids, decoded))
                yield common.batch(schema, *zip(*rows))

    return docs.select(F.col(id_col).alias("doc_id"), common.text_of(text_col).alias("text")).mapInArrow(run, ddl)
