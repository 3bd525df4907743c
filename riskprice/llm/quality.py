"""Line quality by a linear-chain conditional random field.

Each line of a text with a word is an item of a sequence with two labels, content and
boilerplate. The score of a labelling is the sum of a line score (a weighted sum of line
features, for the label content) and a transition score for each pair of neighbours;
Viterbi decoding finds the best labelling of the whole text, and the share of words in
content lines decides whether the document is kept.

Training maximises the conditional likelihood (forward-backward, numpy) over a sample of
labelled documents, of at most ``max_documents`` chosen by a hash of their id, half from
each class. Labels are of documents, so a line has its document's label; in good
documents, lines that come again count as boilerplate. Only line features of the sample
reach the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
ENDS = (".", "!", "?", ":", '"', "”", "…")
REPEAT = 8                      # words in a window that must not come twice
NAMES = ("constant", "length", "symbols", "digits", "capitals", "exclamations", "other_marks", "open_end", "word_length",
         "same_words", "again", "short")
CAPITAL = re.compile("[A-ZÀ-Þ]")
MARK = re.compile(r"[^\w\s.,;!?#*$%&|<>'-]")
DIGIT = re.compile("[0-9]")


def line_features(line: str, words: list[str], again: bool) -> tuple[float, ...]:
    n, size = len(words), len(line)
    return (1.0, min(math.log1p(n) / 5, 1.5), min(4 * sum(map(line.count, SYMBOLS)) / size, 1.0),
            min(4 * len(DIGIT.findall(line)) / size, 1.0), len(CAPITAL.findall(line)) / size,
            min(8 * line.count("!") / size, 1.0), min(4 * len(MARK.findall(line)) / size, 1.0), float(not line.rstrip().endswith(ENDS)),
            min(size / n / 12, 2.0), 1 - len(set(words)) / n, float(again), float(n <= 3))


def lines_of(text: str) -> list[tuple[str, list[str], bool]]:
    """(line, its words, whether an equal line came before) of each line with a word."""
    seen, out = set(), []
    for line in text.split("\n"):
        words = [w.decode("utf-8", "replace") for w in line.encode("utf-8", "surrogatepass").split()]
        if words:
            out.append((line, words, line in seen))
            seen.add(line)
    return out


def repeated_window_words(words: list, n: int = REPEAT) -> int:
    """Words within ``n``-word windows that come twice or more, the first included.

    Exact: words get numbers, then pairs of numbers, pairs of pairs and so on get
    numbers until those of n words."""
    if len(words) <= n:
        return 0
    numbers: dict = {}
    ids, length = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)), 1
    while length < n:
        step = min(length, n - length)
        ids = np.unique(ids[:-step] * (ids.max() + 1) + ids[step:], return_inverse=True)[1]
        length += step
    hit = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + n, -1)
    return int((np.cumsum(edge) > 0).sum())


class LineCrf:
    """weights: line score of content by feature; transition[a, b]: label a before b;
    start: score of content as the first label. Label 1 is content."""

    def __init__(self, weights: np.ndarray, transition: np.ndarray, start: float):
        self.weights, self.transition, self.start = weights, transition, start

    def decode(self, features: np.ndarray) -> list[int]:
        """Viterbi: the best labels (content on ties)."""
        if not len(features):
            return []
        scores = (features @ self.weights).tolist()
        (t00, t01), (t10, t11) = self.transition.tolist()
        a, b, back = 0.0, scores[0] + self.start, []
        for s in scores[1:]:
            from0, from1 = b + t10 >= a + t00, b + t11 >= a + t01
            back.append((from0, from1))
            a, b = (b + t10 if from0 else a + t00), (b + t11 if from1 else a + t01) + s
        out = [int(b >= a)]
        for choice in reversed(back):
            out.append(int(choice[out[-1]]))
        return out[::-1]


def train(sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = 20, rate: float = 0.1,
          penalty: float = 1e-3, batch: int = 64) -> LineCrf:
    """Fit by Adam on the mean negative log-likelihood per line plus an L2 penalty. The
    gradient is observed minus expected counts, from forward and backward passes over
    padded batches. No sequences: a model that calls every line content."""
    k = len(NAMES)
    theta = np.zeros(k + 5)
    if not sequences:
        theta[0] = 1.0
        return LineCrf(theta[:k], theta[k:k + 4].reshape(2, 2), 0.0)
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i][1]))
    batches = [order[i:i + batch] for i in range(0, len(order), batch)]
    mean, square, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for epoch in range(epochs):
        for j in np.random.default_rng(epoch).permutation(len(batches)):
            step += 1
            g = -_gradient([sequences[i] for i in batches[j]], theta) + penalty * theta
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            theta -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return LineCrf(theta[:k].copy(), theta[k:k + 4].reshape(2, 2).copy(), float(theta[-1]))


def _gradient(part: list[tuple[np.ndarray, np.ndarray]], theta: np.ndarray) -> np.ndarray:
    """Gradient of the mean log-likelihood per line of some sequences."""
    k, n, t = len(NAMES), len(part), max(len(y) for _, y in part)
    x, y, on = np.zeros((n, t, k)), np.zeros((n, t), int), np.zeros((n, t))
    for i, (f, labels) in enumerate(part):
        x[i, :len(labels)], y[i, :len(labels)], on[i, :len(labels)] = f, labels, 1
    score = np.zeros((n, t, 2))
    score[:, :, 1] = x @ theta[:k]
    score[:, 0, 1] += theta[-1]
    trans = theta[k:k + 4].reshape(2, 2)
    add = lambda z, axis: np.logaddexp.reduce(z, axis=axis)
    forward, backward = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    forward[:, 0] = score[:, 0]
    for i in range(1, t):
        new = add(forward[:, i - 1, :, None] + trans, 1) + score[:, i]
        forward[:, i] = np.where(on[:, i, None] > 0, new, forward[:, i - 1])
    total = add(forward[:, -1], 1)
    for i in range(t - 2, -1, -1):
        new = add(trans + (score[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
        backward[:, i] = np.where(on[:, i + 1, None] > 0, new, 0.0)
    single = np.exp(forward + backward - total[:, None, None])[:, :, 1] * on
    g = np.zeros_like(theta)
    g[:k] = np.einsum("nt,ntk->k", (y - single) * on, x)
    g[-1] = (y[:, 0] - single[:, 0]).sum()
    if t > 1:
        both = on[:, 1:]
        pair = np.exp(forward[:, :-1, :, None] + trans + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        observed = np.stack([((y[:, :-1] == a) & (y[:, 1:] == b)) * both for a in (0, 1) for b in (0, 1)], -1).sum((0, 1))
        g[k:k + 4] = observed - (pair * both[:, :, None, None]).sum((0, 1)).ravel()
    return g / on.sum()


def _sample(labels: DataFrame, max_documents: int) -> DataFrame:
    """At most half of ``max_documents`` ids of each class, by a hash of the id."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    part = lambda c: known.where(F.col("_quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents // 2)
    return part(0).unionByName(part(1)).withColumnRenamed("doc_id", "_doc")


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = 3000) -> LineCrf:
    """Train on a bounded, hash-chosen sample of the labelled documents (whole texts); a
    doc_id that comes in several rows counts once, by the smallest hash of its text."""
    common.prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for raw, quality in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = lines_of(raw.decode("utf-8", "replace"))
                if lines:
                    rows.append((np.array([line_features(*x) for x in lines], np.float32).tobytes(),
                                 [int(quality and not again) for _, _, again in lines]))
            if rows:
                yield pa.RecordBatch.from_pydict({"x": pa.array([r[0] for r in rows], pa.binary()),
                                                  "y": pa.array([r[1] for r in rows], pa.list_(pa.int32()))})

    chosen = F.broadcast(_sample(labels, max_documents))            # max_documents rows at most
    rows = docs.select("doc_id", common.text_of("text").alias("text")).join(chosen, F.col("doc_id") == F.col("_doc")) \
               .groupBy("doc_id", "_quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("t")) \
               .select(F.col("t.text").alias("text"), "_quality").mapInArrow(run, "x binary, y array<int>").collect()
    rows.sort(key=lambda r: (len(r["y"]), bytes(r["x"])))           # same model whatever the partitions
    return train([(np.frombuffer(r["x"], np.float32).reshape(-1, len(NAMES)).astype(float), np.array(r["y"])) for r in rows])


def judge(docs: DataFrame, model: LineCrf, min_content: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, content_share) of every row.

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated 8-word
    windows. kept: not base_failed and at least ``min_content`` of the words in content
    lines. Null or empty text: no words, so base_failed. Repeated rows and rows with a
    null doc_id are judged like any other; other columns are not read."""
    common.prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                        ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64())])

    def one(raw: bytes) -> tuple:
        text, words = raw.decode("utf-8", "replace"), common.split_words(raw)
        lines = lines_of(text)
        n, repeats = len(words), repeated_window_words(words)
        failed = n < 20 or 100 * repeats > 30 * n
        share = 0.0
        if n:
            found = model.decode(np.array([line_features(*x) for x in lines]))
            share = sum(len(w) for (_, w, _), c in zip(lines, found) if c) / n
        return (n, len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), sum(map(text.count, SYMBOLS)),
                sum(again for _, _, again in lines), repeats, failed, not failed and share >= min_content, share)

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield common.batch(schema, part.column(0), *zip(*(one(t.as_py()) for t in part.column(1))))

    return docs.select("doc_id", common.text_of("text").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "base_failed boolean, kept boolean, content_share double")
