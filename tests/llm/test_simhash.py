import re

import numpy as np
import xxhash

from riskprice.llm import common, simhash


def plain_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    parent = {i: i for i in nodes}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in nodes}


def test_documents(make_docs, edge_rows):
    got = simhash.components(make_docs(edge_rows), 3, 3).collect()
    assert len(got) == len(edge_rows)
    fp = {i: plain_fingerprint(t) for i, t in edge_rows if i is not None}
    expected = plain_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.fp % 2**64 == fp[r.doc_id] and r.component_id == expected[r.doc_id]
    assert simhash.components(make_docs(edge_rows).limit(0)).count() == 0


def test_large_bucket_is_cut_and_keeps_all_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 16)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fps = {int(c ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))))) for c in centres for _ in range(60)}
    nodes = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in nodes.items()], "node long, fp long")
    got = dict(common.connected_components(simhash.links(df, 3)).collect())
    expected = plain_components(sorted(nodes), lambda a, b: (nodes[a] ^ nodes[b]).bit_count() <= 3)
    assert {i: got.get(i, i) for i in nodes} == expected


def test_forest_uses_no_more_edges_than_needed():
    base = np.uint64(12345)
    fp = np.array([base ^ np.uint64(1 << i) for i in range(64)], np.uint64)
    assert len(simhash.forest(fp, None, 3)) == 63


def test_the_pivot_table_does_the_discarding():
    """Among unrelated fingerprints in buckets of every size nearly no pair is left to be
    verified that is not a link, and no link is lost."""
    rng = np.random.default_rng(11)
    fp = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    near = fp[:200] ^ np.left_shift(np.uint64(7), rng.integers(0, 61, 200).astype(np.uint64))       # three bits away
    fp = np.concatenate([fp, near])
    for size in (2, 5, 400, len(fp)):
        bucket = rng.permutation(len(fp)) // size
        bucket[-200:] = bucket[:200]                        # each near copy with its original
        counts = {}
        edges = simhash.forest(fp, None, 3, bucket, counts=counts)
        i, j = np.triu_indices(len(fp), 1)
        same = (bucket[i] == bucket[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= 3)
        assert counts["linked"] == same.sum() >= 200
        assert len(edges) <= counts["linked"]
        unrelated = counts["pairs"] - counts["linked"]
        assert counts["verified"] - counts["linked"] <= 0.001 * unrelated + 3
        assert counts["swept"] < 0.7 * counts["pairs"] + 200


def test_pivot_distances_bound_the_fingerprints_distance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 500, dtype=np.uint64)
    b = a ^ np.uint64(0x8000_0000_0000_0003)
    assert np.abs(simhash.pivot_table(a) - simhash.pivot_table(b)).max() <= 3


def test_drop(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    stay = [i for f, i in ids if not f]
    assert len(stay) == len(set(stay)) and 40 in stay and not {41, 42, 43} & set(stay)
    assert 0 in stay and not {1, 2} & set(stay)             # empty texts are copies of each other
    assert sum(f for f, _ in ids) == 2                      # rows without an id stay
    twice = make_docs([(1, "same words again here"), (1, "same words again here"), (2, "quite another text now")])
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(twice).collect()) == [1, 2]


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1000), (500, 499)], "a long, b long")
    got = dict(common.connected_components(edges).collect())
    assert got == {**{i: 0 for i in range(201)}, 499: 499, 500: 499}
