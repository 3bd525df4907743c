"""Toxicity, quality, decontamination, URL filter."""
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskprice.llm import common, decontaminate, quality, queries, toxicity, url_filter

SF = "/root/testdata/sf0.01"


# toxicity

def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op1_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in common.table(spark, sf, "labels").collect()}
    assert len(rows) == common.table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    y = [(labels[i], r.predicted) for i, r in rows.items() if r.held_out and i in labels]
    caught, called, toxic = sum(a and b for a, b in y), sum(b for _, b in y), sum(a for a, _ in y)
    assert caught / toxic > 0.7 and caught / called > 0.85


def test_risk_stays_positive_and_screening_keeps_signal():
    rng = np.random.default_rng(0)
    draw = lambda bad: np.unique(np.concatenate((rng.integers(10, 3000, 40), rng.integers(0, 5, 2 if bad else 0)))).astype(np.uint64)
    positive, unlabelled = [draw(True) for _ in range(150)], [draw(i % 10 == 0) for i in range(1500)]
    m = toxicity.train(positive, unlabelled, 0.1)
    assert set(range(5)) <= set(m.keys.tolist()) and len(m.keys) < 40
    clean, bad = [m.logit(draw(False)) for _ in range(300)], [m.logit(draw(True)) for _ in range(300)]
    assert np.mean(np.array(clean) < 0) > 0.97 and np.mean(np.array(bad) > 0) > 0.85


def test_toxicity_edges(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows)
    labels = spark.createDataFrame([(10, 1, 1), (11, 1, 0), (11, 1, 0), (None, 1, 1), (12, 1, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    for use in (labels, labels.limit(0), labels.where("toxic = 0")):
        got = toxicity.score(docs, toxicity.fit(docs, use)).collect()
        assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    # the score of a row and the stage's decision agree
    low = sum(r.score < 0.5 for r in toxicity.score(docs, model).collect())
    assert toxicity.drop_toxic(docs, labels).count() == low


# quality

def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {p for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for p in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_quality_counts(make_docs, edge_rows):
    rng = random.Random(2)
    rows = edge_rows + [(200 + i, "".join(rng.choice(["a ", "b ", "c#\n", "\t", "x|y ", "a b c a b c a b c\n"]) for _ in range(rng.randrange(60)))) for i in range(60)]
    model = quality.LineCrf(np.eye(len(quality.NAMES))[0], np.zeros((2, 2)), 0.0)
    got = quality.judge(make_docs(rows), model).collect()
    expected = sorted(((str(i), *plain_counts(t)) for i, t in rows), key=str)
    assert sorted(((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == expected
    assert all(r.kept == (not r.base_failed) for r in got)          # this model calls every line content


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 8))
        m = quality.LineCrf(rng.normal(size=len(quality.NAMES)), rng.normal(size=(2, 2)), float(rng.normal()))
        x = rng.normal(size=(n, len(quality.NAMES)))

        def value(y):
            return sum((x[i] @ m.weights) * y[i] for i in range(n)) + m.start * y[0] + sum(m.transition[y[i], y[i + 1]] for i in range(n - 1))

        best = max(([b >> i & 1 for i in range(n)] for b in range(2**n)), key=value)
        assert value(m.decode(x)) == pytest.approx(value(best))


def test_crf_gradient():
    rng = np.random.default_rng(4)
    k = len(quality.NAMES)
    part = [(rng.normal(size=(n, k)), rng.integers(0, 2, n)) for n in (1, 3, 5)]
    theta = rng.normal(size=k + 5) * 0.3

    def likelihood(t):
        total = 0.0
        for x, y in part:
            n = len(y)
            tr = t[k:k + 4].reshape(2, 2)
            value = lambda z: sum((x[i] @ t[:k]) * z[i] for i in range(n)) + t[-1] * z[0] + sum(tr[z[i], z[i + 1]] for i in range(n - 1))  # noqa: E731, B023
            total += value(y) - np.logaddexp.reduce([value([b >> i & 1 for i in range(n)]) for b in range(2**n)])
        return total / 9

    g = quality._gradient(part, theta)
    for i in range(k + 5):
        d = np.zeros(k + 5)
        d[i] = 1e-5
        assert g[i] == pytest.approx((likelihood(theta + d) - likelihood(theta - d)) / 2e-5, abs=1e-6)


def test_quality_follows_labels(spark):
    rows = {r.doc_id: r for r in queries.op5_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    good = [rows[i].kept for i, q in labels.items() if q == 1 and not rows[i].base_failed]
    poor = [rows[i].kept for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(poor) < 0.1


def test_quality_without_labels(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(edge_rows) and all(r.kept == (not r.base_failed) for r in got)
    assert quality.judge(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_risk_and_direction_against_their_definition():
    """The non-negative risk written out row by row, and its numeric gradient."""
    rng = np.random.default_rng(8)
    soft = lambda z: np.log1p(np.exp(z))
    seen = set()
    for trial in range(40):
        k, prior = 6, float(rng.uniform(0.05, 0.9))
        xp = [rng.permutation(k)[:rng.integers(0, k)] for _ in range(rng.integers(1, 8))]
        xu = [rng.permutation(k)[:rng.integers(0, k)] for _ in range(rng.integers(1, 8))]
        w = rng.normal(size=k + 1)

        def risks(w):
            z = lambda x: sum(w[i] for i in x) + w[-1]
            positive = prior * sum(soft(-z(x)) for x in xp) / len(xp)
            negative = sum(soft(z(x)) for x in xu) / len(xu) - prior * sum(soft(z(x)) for x in xp) / len(xp)
            return positive, negative

        positive, negative, direction = toxicity.step_of(xp, xu, w, prior)
        assert np.allclose((positive, negative), risks(w))
        aim = (lambda w: sum(risks(w))) if negative >= 0 else (lambda w: -risks(w)[1])
        e = 1e-6 * np.eye(k + 1)
        numeric = [(aim(w + d) - aim(w - d)) / 2e-6 for d in e]
        assert np.allclose(direction, numeric, atol=1e-6)
        seen.add(negative >= 0)
    assert seen == {True, False}


def test_terms_are_counted_over_all_documents(spark, make_docs):
    """The choice of terms against plain counts; several rows of one id are one positive."""
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(12)) + (" vile nasty" if i % 6 == 0 else " kind")) for i in range(400)]
    docs, positives = make_docs(rows), make_docs([r for r in rows if r[0] % 6 == 0])
    got = set(toxicity.select_terms(docs, positives.select(common.text_of("text").alias("text")), 4, 4.0).tolist())
    a, b = len([r for r in rows if r[0] % 6 == 0]), len(rows)
    want = set()
    terms = [(i % 6 == 0, toxicity.terms_of(t)) for i, t in rows]
    for w in set().union(*(t for _, t in terms)):
        n, m = sum(w in t for p, t in terms if p), sum(w in t for _, t in terms)
        pooled = (n + m + 1) / (a + b + 2)
        if n >= 4 and (n / a - m / b) / math.sqrt(pooled * (1 - pooled) * (1 / a + 1 / b)) >= 4:
            want.add(int(common.word_hashes([w.encode()])[0]))
    assert got == want and len(want) >= 2
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int")
    repeated = make_docs([(7, f"vile text {i}") for i in range(50)] + [(8, "kind words"), (9, "more kind words")])
    one = toxicity._one_text_an_id(repeated, labels.select(F.col("doc_id").alias("_doc")))
    assert sorted(r.doc_id for r in one.collect()) == [7, 8]


# decontamination

def plain_align(item, passage):
    best = 0
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(200):
        item, passage = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(-1, 5, rng.integers(1, 25))
        score, start, end = decontaminate.align(item, passage)
        assert score == plain_align(item.tolist(), passage.tolist())
        assert score == 0 or plain_align(item.tolist(), passage[start:end].tolist()) == score


def test_copies_and_edited_copies(spark, make_docs, edge_rows):
    rng = random.Random(3)
    items = [" ".join(f"t{i}x{j}" if j % 4 else "the" for j in range(24)) for i in range(30)]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (None, items[0])], "item_id long, text string")
    filler = lambda n: " ".join(f"f{rng.randrange(9999)}" for _ in range(n))
    edited = items[3].split()
    edited[5], edited[12] = "changed", "words"
    del edited[18]
    rows = edge_rows + [(200, filler(30) + " " + items[0] + ". " + filler(9)), (201, "(" + items[1].upper() + ")"),
                        (202, filler(5) + " " + " ".join(edited)), (203, "the the the the " + filler(20)), (204, " ".join(items[5].split()[:6]))]
    rows += [(300 + i, f"{filler(3)} {items[7]}") for i in range(60)]            # a passage that many quote is still found
    docs = make_docs(rows)
    got = decontaminate.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(200, 0), (201, 1), (202, 3), *((300 + i, 7) for i in range(60))}
    assert {(r.start, r.end) for r in got if r.doc_id == 200} == {(30, 54)}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 63
    blocks = decontaminate.leaks(docs, bench, block_words=60).collect()         # many blocks, same findings
    assert sorted(map(str, blocks)) == sorted(map(str, got))
    judged = {r.doc_id: r for r in decontaminate.judge(docs, bench).collect()}
    assert judged[200].contaminated and judged[200].item_id == 0 and not judged[203].contaminated
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_finds_all_benchmark_passages(spark):
    found = {r.doc_id for r in queries.op7_decontamination(spark, SF).collect()}
    grams = set()
    for r in common.table(spark, SF, "benchmark").collect():
        w = decontaminate.words_of(r.text)
        grams.update(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    plain = set()
    for r in common.table(spark, SF, "documents").select("doc_id", "text").collect():
        w = decontaminate.words_of(r.text)
        if any(tuple(w[i:i + 8]) in grams for i in range(len(w) - 7)):
            plain.add(r.doc_id)
    assert found == plain


def test_edited_copy_beside_copies_and_quotes(spark, make_docs):
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(60)]
    edited = [w if i % 5 else "new" for i, w in enumerate(a)]
    rows = [(1, " ".join(a)), (2, " ".join(edited)), (3, " ".join(b))] + [(10 + i, f"x{i} " + " ".join(b[:26]) + f" y{i}") for i in range(1000)]
    bench = spark.createDataFrame([(0, " ".join(a)), (1, " ".join(b))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(make_docs(rows), bench).collect()}
    assert got == {(1, 0), (2, 0), (3, 1), *((10 + i, 1) for i in range(1000))}


def test_every_copy_of_a_stretch(spark, make_docs):
    item = " ".join(f"a{i}" for i in range(20))
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    docs = make_docs([(1, f"x {item} y {item} {item} z"), (2, item), (3, " ".join(["u"] + [item] * 40))])
    got = {(r.doc_id, r.start, r.end) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 1, 21), (1, 22, 42), (1, 42, 62), (2, 0, 20), *((3, 1 + 20 * i, 21 + 20 * i) for i in range(40))}


def test_short_items(spark, make_docs):
    bench = spark.createDataFrame([(1, "What is it?"), (2, "zebu"), (3, "what is"), (4, ""), (5, None), (6, "Zebu")], "item_id long, text string")
    docs = make_docs([(1, "he asks: what IS it, zebus?"), (2, "a zebu! what"), (3, None), (4, "is it what")])
    found = lambda d: {(r.doc_id, r.item_id, r.similarity, r.start, r.end) for r in d.collect()}
    assert found(decontaminate.leaks(docs, bench)) == {(1, 1, 1.0, 2, 5), (1, 3, 1.0, 2, 4), (2, 2, 1.0, 1, 2), (2, 6, 1.0, 1, 2)}
    assert found(decontaminate.leaks(docs, bench, block_words=3)) == found(decontaminate.leaks(docs, bench))


def edit(rng, words, kind):
    """A copy with every few words changed, added or lost."""
    out, step = [], rng.randrange(2, 6)
    for i, w in enumerate(words):
        hit = i % step == step - 1
        if kind == "change" and hit:
            out.append(f"n{rng.randrange(99)}")
        elif kind != "lose" or not hit:
            out += [w, f"n{rng.randrange(99)}"] if kind == "add" and hit else [w]
    return out


def test_finds_what_aligning_every_pair_finds(spark, make_docs):
    """Brute force: every item is aligned with every document. Dense edits, common words,
    repeated words and long items included."""
    rng = random.Random(6)
    pool = ["the", "of", "a"] * 6 + [f"w{i}" for i in range(60)]
    items = [[rng.choice(pool) for _ in range(rng.randrange(8, 70))] for _ in range(25)] + [["the", "of"] * 10]
    rows = [(0, "nothing here")]
    for i in range(120):
        words = edit(rng, rng.choice(items), rng.choice(["change", "add", "lose", "none"]))
        cut = rng.randrange(0, max(1, len(words) // 3))
        text = [rng.choice(pool) for _ in range(rng.randrange(20))] + words[cut:] + [rng.choice(pool) for _ in range(rng.randrange(20))]
        rows.append((i + 1, " ".join(text)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(make_docs(rows), bench).collect()}
    want, numbers = set(), {}
    code = lambda ws: np.array([numbers.setdefault(w, len(numbers)) for w in ws])
    for doc, text in rows:
        for k, item in enumerate(items):
            if decontaminate.align(code(item), code(text.split()))[0] >= min(0.6 * len(item), 24) * 2:
                want.add((doc, k))
    assert got == want and len(want) > 60


def test_a_word_added_after_every_two(spark, make_docs):
    item = [f"a{i}" for i in range(40)]
    text = " ".join(w if i % 2 == 0 else f"{w} new{i}" for i, w in enumerate(item))
    got = decontaminate.leaks(make_docs([(1, text), (2, "a0 a1 new a2 a3")]), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start, r.end) for r in got] == [(1, 7, 0, 59)]


def test_frequent_pairs_are_left_out_of_the_seeds():
    item = [f"w{i}" for i in range(20)]
    block = decontaminate.build_block([(0, item)], 0.6, 24, {})
    documents = np.arange(len(block.pairs))
    first, items = decontaminate.rare_pairs(block, documents)
    rare = np.flatnonzero(np.diff(first))
    left_out = np.setdiff1d(np.arange(len(block.pairs)), rare)
    k = int(decontaminate.least_pairs(block.need)[0])
    assert 0 < len(left_out) and left_out.min() > rare.max() and len({int(block.pairs[g]) // 20 for g in left_out}) <= k - 1
    assert (items == 0).all()


def test_bound_never_cuts_an_alignment():
    rng = np.random.default_rng(1)
    for _ in range(500):
        item, passage = rng.integers(0, 6, rng.integers(3, 12)), rng.integers(-1, 9, rng.integers(3, 40))
        score, start, end = decontaminate.align(item, passage)
        parts = decontaminate.within_reach(passage, np.unique(item), np.unique(item[:-1] * 9 + item[1:]), 9, score)
        assert score == 0 or any(i <= start and end <= j for i, j in parts)


# URL filter

def test_host_and_path_and_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?q#f", "x://h?p/a", "http://h#a/b", "http://org", "https://fr.com/fr/a", "http://com/de/",
            "http://notcom/de/", "http://example.org/en/12", "http://a.b.example.org/EN/1", "ftp://user@h.com:80/fr/?x://y", "http://É.com/fr/"]
    pages = spark.createDataFrame([(i if i else None, u, "html", "mine") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    none = spark.createDataFrame([], "page_id long, good int")
    got = {r.page_id or 0: r for r in url_filter.judge_urls(pages, none, queries.URL_RULES).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best.name), u
        assert got[i].verdict == (best.verdict if best else "block")         # nothing is known of any host
    assert url_filter.judge_urls(pages.limit(0), none, queries.URL_RULES).count() == 0


def plain_suffix(host, rules):
    """The algorithm of public suffix lists, written out."""
    labels, found, excepted = host.split("."), 1, None
    for rule in rules:
        parts = rule.lstrip("!").split(".")
        tail = labels[-len(parts):]
        if len(tail) == len(parts) and all(p in ("*", t) for p, t in zip(parts, tail)):
            if rule.startswith("!"):
                excepted = len(parts) - 1
            found = max(found, len(parts))
    n = found if excepted is None else excepted
    return ".".join(labels[-n:]), ".".join(labels[-n - 1:])


def test_suffix_rules(spark):
    lines = ["// comment", "", "com", "co.kr", "kr", "*.ck", "!www.ck", "*.city.jp", "!town.city.jp", "jp  // more", "a.b.c.net"]
    rules = [x.split("//")[0].split()[0] for x in lines if x.split("//")[0].split()]
    hosts = ["", "com", "x.com", "a.co.kr", "b.co.kr", "co.kr", "www.a.co.kr", "x.kr", "a.b.ck", "b.ck", "ck", "www.ck", "z.www.ck", "p.q.city.jp",
             "town.city.jp", "s.town.city.jp", "city.jp", "x.a.b.c.net", "b.c.net", "unknown", "a.unknown", "1.2.3.4"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: (r.suffix, r.domain) for r in url_filter.with_domains(df, url_filter.suffix_rules(spark, lines)).collect()}
    assert got == {h: plain_suffix(h, rules) for h in hosts}
    assert got["a.co.kr"][1] != got["b.co.kr"][1]


def test_reputation_shrinks_towards_the_domain(spark):
    rows, outcomes, i = [], [], 0
    for host, good, bad in (("a.x.com", 60, 0), ("b.x.com", 1, 0), ("c.y.com", 0, 60), ("d.y.com", 1, 1), ("e.z.net", 20, 20), ("new.y.com", 0, 0)):
        for g in [1] * good + [0] * bad + [None]:
            rows.append((i, host))
            if g is not None:
                outcomes += [(i, g)]
            i += 1
    pages = spark.createDataFrame(rows, "page_id long, host string")
    rep = {r.host: r for r in url_filter.host_reputation(pages, spark.createDataFrame(outcomes, "page_id long, good int")).collect()}
    assert rep["b.x.com"].reputation > rep["e.z.net"].reputation > rep["new.y.com"].reputation >= 0
    assert rep["d.y.com"].reputation < 0.5 and rep["a.x.com"].lower_bound > 0.8 and rep["new.y.com"].n == 0
    assert all(0 < r.reputation < 1 and r.lower_bound < r.reputation for r in rep.values())


def test_url_oracle(spark):
    got = sorted(map(tuple, queries.op8_url_filter(spark, SF).collect()))
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    assert got == sorted(con.execute(queries.oracle_sql()["op8_url_filter"]).fetchall())
