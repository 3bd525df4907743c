"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic documents (positives) and other documents whose labels it
does not look at (unlabelled). With the class prior p, the risk of a scorer is

    p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)])

The part in max() estimates the risk on negatives without any negative example; it can't
be below zero, and where a batch drives it below zero the step undoes that part instead
(Kiryo et al., 2017). The classifiers are linear over the presence of words, trained in
numpy with the logistic loss; their mean logit is the score. Only words and
beginnings of words whose share among the positives is ``min_z`` standard errors above that
among all documents have a weight, which keeps a few positives from being learnt by heart.

``prior`` is the share of toxic documents among the labelled ones of the training part.
Terms are counted over all documents of that part. The weights are trained on at most
``max_positive`` and ``max_unlabelled`` documents, chosen by a hash of their id, and whole
texts of each; only hashes of the chosen terms reach the driver. Every document is scored by
its whole text.
"""

from __future__ import annotations

import math
import string
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BEGINNINGS = (4, 5)             # letters
STRIP = string.punctuation + "«»„“”‘’…¡¿–—"


def words_of(text: str) -> set[str]:
    """Distinct words: lower-cased, cut at white space, without marks at their ends."""
    return {w.strip(STRIP) for w in text.lower().split()}


def terms_of(text: str) -> set[str]:
    """Distinct words, and with an asterisk the beginnings of longer words, which gather
    their inflected forms."""
    words = words_of(text)
    return words | {w[:n] + "*" for n in BEGINNINGS for w in words if len(w) > n}


def features(raw: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the terms of a UTF-8 text."""
    return np.sort(common.word_hashes([w.encode() for w in terms_of(raw.decode("utf-8", "replace"))]))


class Model(NamedTuple):
    keys: np.ndarray            # sorted word hashes
    weights: np.ndarray
    bias: float

    def logit(self, found: np.ndarray) -> float:
        if not len(self.keys) or not len(found):
            return self.bias
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        return float(self.bias + self.weights[at[self.keys[at] == found]].sum())


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def stands_out(counts: np.ndarray, a: int, everywhere: np.ndarray, b: int) -> np.ndarray:
    """By how many standard errors each term's share among ``a`` positives is above its share
    among ``b`` documents."""
    pooled = (counts + everywhere + 1) / (a + b + 2)
    return (counts / a - everywhere / b) / np.sqrt(pooled * (1 - pooled) * (1 / a + 1 / b))


def _chance(prior: float) -> Model:
    return Model(np.empty(0, np.uint64), np.empty(0), float(np.log(prior / (1 - prior))))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, models: int = 3, epochs: int = 150,
          min_documents: int = 4, min_z: float = 4.0, rate: float = 0.1, penalty: float = 1e-5,
          keys: np.ndarray | None = None) -> Model:
    """Fit ``models`` classifiers that differ in the order of their batches and average
    them. Only the sorted ``keys`` have a weight; without them, those of ``min_documents``
    positives or more that stand out by ``min_z`` standard errors among the texts given.
    Without positives or unlabelled texts the score is the prior everywhere."""
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    if not positive or not unlabelled:
        return _chance(prior)
    if keys is None:
        keys, counts = np.unique(np.concatenate(positive), return_counts=True)
        keys, counts = keys[counts >= min_documents], counts[counts >= min_documents]
        everywhere, total = np.unique(np.concatenate(unlabelled), return_counts=True)
        common_counts = np.zeros(len(keys))
        if len(everywhere):
            at = np.minimum(np.searchsorted(everywhere, keys), len(everywhere) - 1)
            common_counts = np.where(everywhere[at] == keys, total[at], 0)
        keys = keys[stands_out(counts, len(positive), common_counts, len(unlabelled)) >= min_z]

    def rows(texts):
        """(start of each text, columns): a sparse 0/1 matrix by rows."""
        columns = []
        for f in texts:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
                columns.append(at[keys[at] == f])
            else:
                columns.append(np.empty(0, np.int64))
        return columns

    xp, xu = rows(positive), rows(unlabelled)
    fits = [_train_one(xp, xu, len(keys), prior, epochs, rate, penalty, np.random.default_rng(seed)) for seed in range(models)]
    return Model(keys, np.mean([w[:-1] for w in fits], 0), float(np.mean([w[-1] for w in fits])))


def step_of(xp: list[np.ndarray], xu: list[np.ndarray], w: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(risk on positives, corrected risk on negatives, direction to go down) of a linear
    scorer with weights ``w``, the last one its bias; a text is the places of its terms. The
    direction is the gradient of the sum of both risks, or, where the second is below zero,
    that of the second upwards."""
    k = len(w) - 1

    def scores(part):
        row = np.repeat(np.arange(len(part)), [len(c) for c in part])
        column = np.concatenate(part) if part else np.empty(0, np.int64)
        return row, column, np.bincount(row, w[column], len(part)) + w[-1]

    def gradient(row, column, dz):
        g = np.bincount(column, dz[row], k + 1).astype(float)      # of no columns: integers
        g[-1] = dz.sum()
        return g

    *p, zp = scores(xp)
    *u, zu = scores(xu)
    sp, su = _sigmoid(zp), _sigmoid(zu)
    # logistic loss: loss(+) = log(1 + exp(-z)) with slope s - 1, loss(-) = log(1 + exp(z)) with slope s
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    g_positive = gradient(*p, prior * (sp - 1) / len(xp))
    g_negative = gradient(*u, su / len(xu)) - gradient(*p, prior * sp / len(xp))
    return positive, negative, g_positive + g_negative if negative >= 0 else -g_negative


def _train_one(xp, xu, k, prior, epochs, rate, penalty, rng):
    w = np.zeros(k + 1)
    w[-1] = np.log(prior / (1 - prior))
    mean, square, step = np.zeros(k + 1), np.zeros(k + 1), 0
    batches = max(1, min(len(xu) // 3000, 6))
    for _ in range(epochs):
        parts = zip(np.array_split(rng.permutation(len(xp)), batches), np.array_split(rng.permutation(len(xu)), batches))
        for ip, iu in parts:
            if not len(ip) or not len(iu):
                continue
            _, _, g = step_of([xp[i] for i in ip], [xu[i] for i in iu], w, prior)
            g[:-1] += penalty * w[:-1]
            step += 1
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            w = w - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
            w[:-1] = np.maximum(w[:-1], 0)      # a term that stands out among the positives never counts against it
    return w


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by five: never used in training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _one_text_an_id(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, text, the other columns of ``chosen``) of the chosen ids, which are bounded in
    number: one row an id, that of the smallest text hash."""
    rest = [c for c in chosen.columns if c != "_doc"]
    rows = docs.select("doc_id", common.text_of("text").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_doc"))
    return rows.groupBy("doc_id", *rest).agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("t")) \
               .select("doc_id", F.col("t.text").alias("text"), *rest)


def select_terms(docs: DataFrame, positives: DataFrame, min_documents: int, min_z: float) -> np.ndarray:
    """Sorted hashes of the terms of ``min_documents`` positives or more whose share among
    them stands out by ``min_z`` standard errors over that among all documents. Counted by
    Spark: over the bounded positives, then over every document for the terms that the first
    count leaves."""
    def terms(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):            # few texts' terms are held at a time
                found = [features(t.as_py()) for t in b.column(0)[at:at + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(common.signed(np.concatenate([*found, np.empty(0, np.uint64)])))], names=["term"])

    counted = positives.select("text").mapInArrow(terms, "term long").groupBy("term").agg(F.count(F.lit(1)).alias("n")) \
                       .where(F.col("n") >= min_documents).toArrow()
    keys, counts = counted["term"].to_numpy().view(np.uint64), counted["n"].to_numpy()
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys

    def everywhere(batches):
        import xxhash
        h, get = xxhash.xxh3_64_intdigest, {int(k): i for i, k in enumerate(keys.tolist())}.get
        total, n = np.zeros(len(keys), np.int64), 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                found: list[int] = []
                for t in b.column(0)[at:at + 256]:
                    hashes = map(h, [w.encode() for w in terms_of(t.as_py().decode("utf-8", "replace"))])
                    found += [i for i in map(get, hashes) if i is not None]
                    n += 1
                total += np.bincount(np.array(found, np.int64), minlength=len(keys))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["at", "n"])

    rows = docs.select(common.text_of("text").alias("text")).mapInArrow(everywhere, "at long, n long") \
               .groupBy("at").agg(F.sum("n").alias("n")).toArrow()          # a row a term at most; -1: the documents
    at, n = rows["at"].to_numpy(), rows["n"].to_numpy()
    total = np.zeros(len(keys))
    total[at[at >= 0]] = n[at >= 0]
    documents = int(n[at < 0].sum())
    return keys[stands_out(counts, positives.count(), total, max(documents, 1)) >= min_z]


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 6_000, max_unlabelled: int = 18_000, min_documents: int = 4,
        min_z: float = 4.0) -> Model:
    """Train on documents outside the held-out part: the terms are chosen by counts over all
    of them, the weights come from at most ``max_positive`` and ``max_unlabelled`` documents.
    A doc_id with several labels is toxic if any of them says so; one with several rows
    counts once; null ids and null labels teach nothing."""
    common.prepare(docs.sparkSession)
    usable = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    known = labels.where(usable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.avg("toxic").alias("prior")).first()
    first = lambda ids, n: ids.select(F.col("doc_id").alias("_doc")).distinct().orderBy(F.xxhash64("_doc"), "_doc").limit(n)
    positives = common.cut(_one_text_an_id(docs, first(known.where("toxic = 1"), max_positive)))
    keys = select_terms(docs.where(usable), positives, min_documents, min_z)

    def run(batches):
        for b in batches:
            found = [f[np.isin(f, keys, assume_unique=True)].tobytes() for f in (features(t.as_py()) for t in b.column(0))]
            yield pa.RecordBatch.from_pydict({"x": pa.array(found, pa.binary())})

    def sparse(texts: DataFrame) -> list[np.ndarray]:
        """The chosen terms of each text, in an order that does not depend on partitions."""
        rows = texts.select("text").mapInArrow(run, "x binary").toArrow()["x"]
        return [np.frombuffer(x, np.uint64) for x in sorted(r.as_py() for r in rows)]

    unlabelled = _one_text_an_id(docs, first(docs.where(usable), max_unlabelled))
    return train(sparse(positives), sparse(unlabelled), counts["prior"] or 0.0, keys=keys)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; the score reads the text only.
    Null text: empty, scored like any other. Other columns are not read."""
    common.prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        weights = dict(zip(model.keys.tolist(), model.weights.tolist()))
        import xxhash
        h, get = xxhash.xxh3_64_intdigest, weights.get
        for b in batches:
            logits = np.zeros(b.num_rows)
            for i, t in enumerate(b.column(2)):
                found = [x for w in terms_of(t.as_py().decode("utf-8", "replace")) if (x := get(h(w.encode(), 0))) is not None]
                logits[i] = model.bias + math.fsum(found)
            s = _sigmoid(logits)
            yield common.batch(schema, b.column(0), b.column(1), s, (s >= 0.5).astype(np.int32))

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), common.text_of("text").alias("text")) \
               .mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents that score under ``threshold``, with all their columns. The score is a
    column of the same rows: nothing is joined or shuffled."""
    model = fit(docs, labels)

    @F.pandas_udf("double")
    def of(texts):
        import pandas as pd
        return pd.Series([_sigmoid(model.logit(features(t))) for t in texts], dtype="float64")

    return docs.where(of(common.text_of("text")) < threshold)
