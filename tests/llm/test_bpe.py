import hashlib
import random

import pytest
import tiktoken
import public_tokenizers as P

from riskprice.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_pieces_agree_with_the_pattern(reference):
    rng = random.Random(1)
    alphabet = "'strevmldae LE\n\t\u00a0\u3000é中1٣½!?#-\x1c\x85😀ǅʰ\u1c89\U00010d40"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(6000)]
    texts += ["", "x" * 3000, " " * 2000, "'" * 50 + "s", "we'll they'Re 's'st'd I'm" * 20, "ab" * 1500 + "!'s's're'll"]
    enc = bpe.Encoder(bpe.load_ranks(PATH), cache_size=500)     # small: the cache empties often
    for text, (pieces, offsets) in zip(texts, bpe.encode_batch([t.encode() for t in texts], enc)):
        ids = [i for p in pieces for i in p]
        assert ids == reference.encode_ordinary(text), text
        assert enc.decode(ids) == text.encode() and offsets[-1] == len(text.encode()) and len(offsets) == len(pieces) + 1


def test_scan_is_a_fold():
    import numpy as np
    _, compose, _ = bpe.monoid()
    f = np.random.default_rng(0).integers(0, len(compose), 5000).astype(np.uint8)
    out, state = bpe.scan(f, compose, block=16), None
    for got, x in zip(out, f):
        state = x if state is None else compose[state, x]
        assert got == state


def test_documents(make_docs, edge_rows, reference):
    docs = make_docs(edge_rows)
    got = bpe.encode_digests(docs, PATH).collect()
    assert len(got) == len(edge_rows)
    expected = []
    for i, t in edge_rows:
        ids = reference.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(expected, key=key)
    full = bpe.encode_documents(docs, PATH).where("doc_id = 50").first()
    assert bytes(full.decoded).decode().startswith("é ü 東京 😀") and len(full.token_ids) == full.n_tokens
    assert bpe.encode_digests(docs.limit(0), PATH).count() == 0
