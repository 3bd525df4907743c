import hashlib
import random
import re

from pyspark.sql import functions as F

from riskprice.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_base_spans(make_docs):
    rng = random.Random(5)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(rng.randrange(n)))
    texts = [draw("ab.@-_+ 0123456789()é😀%\n", 60) for _ in range(700)] + [draw("0123456789. -+()", 80) for _ in range(900)]
    texts += [draw("ab.@1", 40) for _ in range(500)]
    texts += [None, "", "a@b.c" * 900, " 1.2.3.4 x" * 1500, "4" * 3000, "a" * 3000 + "@", "4111 1111-1111 1111 0001.2.3.255 256.1.1.1"]
    df = make_docs(list(enumerate(texts)))
    got = df.select("doc_id", pii.base_spans(F.coalesce("text", F.lit(""))).alias("x")).collect()
    for r in got:
        assert [(x.s, x.k, x.e) for x in r.x] == [x[:3] for x in plain_spans(texts[r.doc_id])]


def test_long_runs_take_linear_time(make_docs):
    df = make_docs([(1, "a" * 400_000 + "@"), (2, "4" * 400_000), (3, "1-" * 200_000), (4, "+1 " * 100_000)])
    assert [r.n_email for r in pii.find(df).collect()] == [0] * 4


def test_disclosing_terms(make_docs):
    rows = [(i, f"filler{i} agent zorbo{i % 2} writes bob@x.org today word{i}") for i in range(6)]
    rows += [(10 + i, f"the agent today writes nothing {i}") for i in range(200)]
    rows += [(500, "zorbo1 alone"), (501, None), (None, "x +1 (555) 555-1234 y"), (502, "Zorbo0 and zorbo0x")]
    docs = make_docs(rows)
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert found[0].spans == "remove:14:20,email:28:37" or found[0].spans == "generalise:14:20,email:28:37"
    assert found[500].spans == "generalise:0:6" and found[502].n_terms == 1 and found[10].spans == ""
    assert found[0].base_sha256 == hashlib.sha256(b"email:28:37").hexdigest() and found[None].n_phone == 1
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[500] == "[WORD] alone" and clean[501] is None and clean[None] == "x [PHONE] y"
    assert "[EMAIL]" in clean[0] and "bob" not in clean[0] and clean[10] == "the agent today writes nothing 0"
    assert pii.sanitise(docs).columns == docs.columns


def test_disclosing_numbers(make_docs):
    rows = [(i, f"filler{i} account 77889{i % 2} belongs to bob@x.org today word{i}") for i in range(6)]
    rows += [(10 + i, f"f{i} the phone +1 (555) 867-5309 or eve@y.org today w{i}") for i in range(6)]
    rows += [(100 + i, f"the account {i} belongs to nothing and the phone or today") for i in range(300)]
    rows += [(500, "see 778891 alone"), (501, "room 867 is open"), (502, "7788901"), (503, "778891 again")]
    docs = make_docs(rows)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "778890" not in clean[0] and "778891" not in clean[1] and clean[500] == "see [NUMBER] alone"
    assert clean[501] == "room 867 is open" and clean[502] == "7788901" and clean[105] == rows[17][1]
    # eve and y, but no number of the phone
    assert {r.n_terms for r in pii.find(docs).where("doc_id BETWEEN 10 AND 15").collect()} == {2}


def test_spellings_are_one_entity(make_docs):
    mails, cards = ["Bob@x.org", "bob@x.org", "bob@X.ORG"], ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"]
    rows = [(i, f"a{i} zorbo says {m} b{i}") for i, m in enumerate(mails)] + [(10 + i, f"c{i} quux pays {c} d{i}") for i, c in enumerate(cards)]
    rows += [(100 + i, f"he says and pays nothing {i}") for i in range(300)]
    clean = {r.doc_id: r.text for r in pii.sanitise(make_docs(rows)).collect()}
    assert [clean[i] for i in range(3)] == [f"a{i}  says [EMAIL] b{i}" for i in range(3)]
    assert [clean[10 + i] for i in range(3)] == [f"c{i}  pays [CARD] d{i}" for i in range(3)]


def test_copies_prove_nothing(make_docs):
    docs = make_docs([(i, "unusualword next to bob@x.org here") for i in range(20)])
    assert {r.spans for r in pii.find(docs).collect()} == {"email:20:29"}


def test_overlaps_and_edges(make_docs, edge_rows):
    docs = make_docs(edge_rows + [(90, "call +4111111111111111 or 10.0.0.1@host.org!")])
    r = {r.doc_id: r for r in pii.find(docs).collect()}[90]
    assert r.n_email == 1 and r.n_ip == 1 and r.n_card == 1
    text = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "4111" not in text[90] and "10.0.0.1" not in text[90] and text[90].endswith("!")
    assert text[40] == dict(edge_rows)[40] and text[1] == "" and text[0] is None
    assert pii.find(docs).count() == len(edge_rows) + 1 and pii.find(docs.limit(0)).count() == 0


def test_no_python_on_the_executors(make_docs, edge_rows, capsys):
    pii.find(make_docs(edge_rows)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def plain_all_spans(rows):
    """Base spans and disclosing terms of every row by their definition, in plain Python."""
    import math
    from collections import Counter, defaultdict

    import regex
    word = r"[\p{L}\p{M}\p{N}]"
    words = lambda t: regex.findall(f"{word}+", t.lower())
    counts = Counter(w for _, t in rows for w in words(t or ""))
    n = max(sum(counts.values()), 1)
    seen, entities = defaultdict(Counter), Counter()
    for _, text in rows:
        text = text or ""
        base = plain_spans(text)
        bare = list(text)
        for s, _, e, _ in base:
            bare[s:e] = " " * (e - s)
        bare = "".join(bare)
        for s, k, e, kind in base:
            v = text[s:e]
            plain = v.lower() if kind == "email" else regex.sub("(?<![0-9])0+(?=[0-9])", "", v) if kind == "ip" else regex.sub("[^0-9]", "", v)

            def around(t):
                left, right = t[max(s - 80, 0):s], t[e:e + 80]
                return ((regex.sub(f"^{word}*", "", left) if len(left) == 80 else left) + " "
                        + (regex.sub(f"{word}*$", "", right) if len(right) == 80 else right))

            near = {w for w in words(around(text)) if regex.search("[^0-9]", w)}
            near |= set(regex.findall(f"(?<!{word})[0-9]+(?!{word})", around(bare)))
            entities[k, plain] += 1
            for w in near:
                seen[(k, plain), w][text[max(s - 80, 0):s], text[e:e + 80]] += 1
    told = {}
    for (entity, w), contexts in seen.items():
        if len(contexts) >= 3:
            x = math.log2(sum(contexts.values()) * n / (counts[w] * entities[entity])) / math.log2(n / entities[entity])
            told[w] = max(told.get(w, -9), x)
    acts = {w: 5 if x >= 0.95 else 4 for w, x in told.items() if x >= 0.90}
    out = []
    for i, text in rows:
        text = text or ""
        spans = [(s, k, e) for s, k, e, _ in plain_spans(text)]
        if i is not None:
            for w in set(words(text)) & set(acts):
                spans += [(m.start(), acts[w], m.end()) for m in regex.finditer(f"(?i)(?<!{word}){w}(?!{word})", text)]
        out.append((i, ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))))
    return sorted(out, key=repr)


def test_all_spans_against_plain_counts(make_docs):
    """Random texts around few entities: rare and frequent terms, numbers, several spellings,
    long surroundings, repeated and id-less rows."""
    rng = random.Random(12)
    people = ["ann@x.org", "Ann@X.org", "10.0.0.1", "010.0.0.1", "+1 (555) 867-5309", "4111 1111 1111 1111", "bob.b@y.com"]
    rare = {p: [f"nick{k}", f"Place{k}", str(7000 + k)] for k, p in enumerate(people)}
    pool = [f"w{i}" for i in range(120)] + ["the", "of", "12", "é"] * 20
    rows = []
    for i in range(260):
        text = [rng.choice(pool) for _ in range(rng.randrange(3, 30))]
        for p in rng.sample(people, rng.randrange(0, 3)):
            at = rng.randrange(len(text))
            text[at:at] = rng.sample(rare[p], rng.randrange(0, 4)) + [p] + [rng.choice(pool)]
        if rng.random() < 0.4:
            text.append(rng.choice(rare[rng.choice(people)]))
        rows.append((i, " ".join(text)))
    rows += [rows[3], rows[4], (None, rows[5][1]), (900, None), (901, "")]
    got = sorted(((r.doc_id, r.spans) for r in pii.find(make_docs(rows)).collect()), key=repr)
    assert got == plain_all_spans(rows)
    assert any("generalise" in s for _, s in got) and any("remove" in s for _, s in got)
