"""Importance resampling against its definition written out."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from riskprice.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return words, words + [a + " " + b for a, b in zip(words, words[1:])]


def plain(rows, target, percent=25, min_words=20, k=10_000):
    bucket = lambda f: crc32(f.encode()) % k
    corpus = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    goal = Counter(bucket(f) for t in target for f in features(t)[1])
    s, t = sum(corpus.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * (s + k) / ((corpus[b] + 1) * (t + k))))
    out = []
    for doc_id, text in rows:
        words, f = features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(f), weight, score, None, len(words)])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[5]))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.fixture(scope="module")
def goal(spark):
    texts = ["w1 w2 w3 What is 東京 w9?", "it's W7 w8 w1 w2", None, ""]
    return texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


@pytest.mark.parametrize("percent", [0, 1, 25, 60, 100])
def test_edges(spark, make_docs, edge_rows, goal, percent):
    rng = random.Random(percent)
    rows = edge_rows + [(200 + i, " ".join(f"W{rng.randrange(300)}" for _ in range(rng.randrange(15, 60)))) for i in range(40)]
    rows += [(None, "a b " * 12), (7, "x1-x2_x3\x85é " * 9), (8, "q" * 5000 + " " + "z9 " * 3000)] + [(300, "tie " * 25)] * 6
    assert got(R.resample(make_docs(rows), goal[1], percent)) == plain(rows, goal[0], percent)


def test_the_cutoff_takes_rounds(spark, make_docs, goal, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(22))) for i in range(700)] + [(5000, "same text " * 11)] * 300
    exact = R.cutoff
    monkeypatch.setattr(R, "cutoff", lambda keys, n: exact(keys, n, few=5))
    assert got(R.resample(make_docs(rows, 7), goal[1])) == plain(rows, goal[0])


def test_empty_tables(spark, make_docs, goal):
    assert got(R.resample(make_docs([(1, "x")]).limit(0), goal[1])) == []
    rows = [(i, "some words " * 10) for i in range(8)]
    assert got(R.resample(make_docs(rows), goal[1].limit(0))) == plain(rows, [])


def test_cutoff_is_the_nth_key(spark):
    rng = np.random.default_rng(4)
    keys = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(-5, 5, 400), rng.integers(0, 2, 400), rng.integers(0, 30, 400))]
    table = spark.createDataFrame(keys, "low long, null long, id long").repartition(6).persist()
    for n in (1, 2, 57, 200, 399, 400):
        assert tuple(R.cutoff(table, n, few=3)) == sorted(keys)[n - 1]
    assert R.cutoff(table, 0) is None
    with pytest.raises(ValueError):
        R.cutoff(table, 401)
    table.unpersist()


def test_words_of_long_texts_come_in_parts():
    text = ("Abc déf 12 " * 5000 + "x" * 300).encode()
    whole = features(text.decode())[0]
    assert [w.decode() for part in R.word_lists(text, 97) for w in part] == whole
