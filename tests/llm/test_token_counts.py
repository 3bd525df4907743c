"""Token counts against the tokenizers library on whole texts."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskprice.llm import token_counts as T

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["a", "B", "é", "é", "'s", "'", "don't", "12", "7", ",", "...", "東京", "、", "<|endoftext|>", "<|endof", "😀", " ", "\n",
            "\t", " ", "\x1f", "̸", "Σ", "word", "İ", "'re,", "x'll"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def whole(library, text):
    return len(library.encode(text or "", add_special_tokens=False))


def test_edges_and_huge_documents(spark, make_docs, edge_rows, library):
    rng = random.Random(4)
    rows = edge_rows + [(60, "".join(rng.choice(ALPHABET) for _ in range(3000))), (61, "x" * 900 + "<|endoftext|>" * 90),
                        (62, "a<|endoftext|>b <|startoftext|>"), (63, "東京" * 500), (63, "東京" * 500), (None, "q1" * 700)]
    found = T.count(make_docs(rows), PATH, limit=50, chunk=256, overlap=32).collect()
    want = sorted(((i, len((t or "").encode()), whole(library, t)) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found), key=repr) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 50) for r in found)
    assert T.count(make_docs([(1, "a")]).limit(0), PATH).collect() == []


@pytest.mark.parametrize("size, overlap", [(64, 32), (100, 34), (200, 40)])
def test_random_texts_in_chunks(spark, make_docs, library, size, overlap):
    rng = random.Random(size + overlap)
    rows = [(i, "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60, 500)))) for i in range(60)]
    rows += [(100 + i, "".join(rng.choice("abcdefgh") for _ in range(300))) for i in range(4)]      # nothing stable inside
    found = {r["doc_id"]: r["n_tokens"] for r in T.count(make_docs(rows), PATH, chunk=size, overlap=overlap).collect()}
    assert found == {i: whole(library, t) for i, t in rows}


def test_stable_positions_cut_nothing(library):
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(ALPHABET) for _ in range(30))
        total = whole(library, text)
        for p in T.stable(text).tolist():
            assert whole(library, text[:p]) + whole(library, text[p:]) == total, (text, p)


def test_chunks_cover_the_text():
    for length in range(1, 300):
        chunks = T.spans(length, 40, 12)
        assert chunks[0][0] == 0 and chunks[-1][1] == length
        assert all(b[0] < a[1] and a[1] - b[0] == 12 for a, b in zip(chunks, chunks[1:]))
