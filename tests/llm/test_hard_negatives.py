"""Hard negatives against plain search over all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskprice.llm import hard_negatives as H

DDL = "vec_id long, embedding array<float>, label int, score double, n long, v string, k1 long, grp long"


def frame(spark, rows, partitions=4):
    return spark.createDataFrame([(i, v, y, 1.0, 1, "x", 0, 0) for i, v, y in rows], DDL).repartition(partitions)


def plain(rows, positives=5, negatives=5, every=10):
    """The definition, row by row."""
    seen = set()
    sound = []
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        if (i, y, w) not in seen:
            seen.add((i, y, w))
            sound.append((i, w, y))
    out = []
    for a in sound:
        if a[0] % every:
            continue
        near = lambda rows: sorted(((-sum(p * q for p, q in zip(a[1], r[1])), r[0]) for r in rows))
        good = near(r for r in sound if r is not a and r[2] == a[2])[:positives]
        bad = near(r for r in sound if r[2] != a[2])
        for s, i in good:
            fit = [(t, j) for t, j in bad if 80 * -s <= 100 * -t <= 100 * -s][:negatives]
            out += [(a[0], i, k + 1, j, -s, -t) for k, (t, j) in enumerate(fit)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                               "negative_score").collect()), key=repr)


def sphere(rng, n, d, start=0, labels=4):
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(start + i, [float(c) for c in v], int(rng.integers(labels))) for i, v in enumerate(x)]


def test_random_rows_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 16)                             # several blocks of anchors
    monkeypatch.setattr(H, "SAMPLE", 64)                            # first thresholds far from the last
    rng = np.random.default_rng(3)
    rows = sphere(rng, 400, 24)
    common_vector = rows[10][1]
    rows += [(1000 + i, common_vector, i % 2) for i in range(150)]  # copies, anchors among them
    rows += [(2000 + i, [float(round(c)) for c in 2 * rng.standard_normal(24)], i % 3) for i in range(60)]    # many ties
    random.Random(1).shuffle(rows)
    assert got(H.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)) == plain(rows)


def test_edges(spark):
    rng = np.random.default_rng(5)
    rows = sphere(rng, 40, 6)
    rows += [(100, None, 1), (110, [0.1, None, 0.2], 1), (120, [float("nan"), 1.0], 2), (130, [float("inf")], 2),
             (140, [0.5] * 6, None), (None, [0.5] * 6, 1), (150, [], 1), (160, [0.0] * 6, 2), (170, [1.0, 2.0], 3),
             rows[0], rows[0], (rows[0][0], [0.25] * 6, rows[0][2])]
    assert got(H.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)) == plain(rows)
    few = frame(spark, [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.85, 0.0], 2)])
    assert got(H.mine(few, F.col("vec_id") % 10 == 0)) == plain([(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.85, 0.0], 2)])
    assert got(H.mine(frame(spark, []), F.col("vec_id") % 10 == 0)) == []
    assert got(H.mine(few, F.col("vec_id") < 0)) == []


@pytest.mark.parametrize("t", [-np.inf, -5.0, 0.0, 100.0, 20000.0, 1e9])
def test_threshold_pairs_loses_nothing(t):
    rng = np.random.default_rng(11)
    x, q = rng.integers(-200, 200, (300, 37)), rng.integers(-200, 200, (40, 37))
    x[:20] = 0
    q[0] = 0
    limits = np.full(40, t)
    limits[::3] = limits[::3] + 10000
    a, r, s = H.threshold_pairs(x, q, limits)
    exact = q @ x.T
    want = {(i, j) for i, j in zip(*np.nonzero(exact >= limits[:, None]))}
    assert set(zip(a.tolist(), r.tolist())) == want and len(a) == len(want)
    assert (s == exact[a, r]).all()


def test_the_index_leaves_out_dimensions_and_bounds_prune():
    rng = np.random.default_rng(2)
    scale = 0.7 ** np.arange(48)                                    # energy falls along the dimensions
    x = np.floor(256 * rng.standard_normal((2000, 48)) * scale).astype(int)
    counts = {}
    q = x[:50]
    limits = 0.8 * (q * q).sum(axis=1)
    a, _, _ = H.threshold_pairs(x, q, limits.astype(float), counts)
    assert counts["indexed"] < 0.4 * x.size                         # most components are in no list
    assert counts["scored"] < 1.5 * len(a) + 50                     # few pairs are scored in vain


def test_large_components_are_exact():
    x = np.array([[2**31, 3], [2**31, 2]])
    _, _, s = H.threshold_pairs(x, x, np.array([-np.inf, -np.inf]))
    assert sorted(s.tolist()) == sorted([2**62 + 9, 2**62 + 6, 2**62 + 6, 2**62 + 4])
    with pytest.raises(OverflowError):
        H.threshold_pairs(np.array([[2**40]]), np.array([[2**40]]), np.array([-np.inf]))


def test_query_equals_its_sql(spark):
    import duckdb

    from riskprice.llm import queries
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    found = con.execute(queries.oracle_sql()["op11_hard_negatives"])
    columns = [d[0] for d in found.description]
    df = queries.op11_hard_negatives(spark, sf)
    assert df.columns == columns
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall()) and df.count() > 100
