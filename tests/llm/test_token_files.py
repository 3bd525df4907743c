import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from riskprice.llm import token_files

PATH = P.path("byte_bpe_50k.json")


def test_round_trip(spark, make_docs, edge_rows, tmp_path):
    edge_rows = edge_rows + [(70, "a <|endoftext|> b<|endoftext|>"), (71, "<|endoftext|>" * 3), (72, "<|endof text|>")]
    docs = make_docs(edge_rows)
    manifest = token_files.write_token_files(docs, PATH, end_id=0, folder=f"file://{tmp_path}", partitions=3)
    got = token_files.read_token_files(spark, manifest, chunk=4).collect()
    t = Tokenizer.from_file(PATH)                       # as it is: special strings in a text are special tokens
    expected, total = {}, 0
    for i, text in edge_rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        expected.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
        total += len(ids)
    rows = sorted(got, key=lambda r: r.start)
    assert [r.doc_id is None for r in rows] == sorted((r.doc_id is None for r in rows), reverse=True)
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert ids == sorted(ids)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert at == total
    for i, want in expected.items():
        assert sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == i) == sorted(want)


def test_empty_table(spark, make_docs, tmp_path):
    manifest = token_files.write_token_files(make_docs([(1, "x")]).limit(0), PATH, folder=str(tmp_path), partitions=2)
    assert token_files.read_token_files(spark, manifest).count() == 0


def test_pieces_do_not_change_ids():
    enc = token_files.LibraryEncoder(PATH, cache_size=8)
    texts = ["a  b\n\n c \n", "  lead", "tail  ", "x\u00a0 y", "tab\t z", "<|endoftext|> end", "it's\n'quoted' we'll", "", " ", "w " * 200 + "v" * 100] * 3
    untouched = Tokenizer.from_file(PATH)
    plain = [np.array(e.ids, enc.dtype).tobytes() for e in untouched.encode_batch(texts, add_special_tokens=False)]
    assert [enc.encode([t])[0] for t in texts] == plain and enc.encode(texts) == plain


def test_even_and_uneven_texts(monkeypatch):
    import random
    rng = random.Random(8)
    parts = ["word", "w", " ", "\n", "é", "東京", "<", "|", "<|endoftext|>", "12", "'s", "don't", "😀", "\t", "　", ".", "\x1f"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(600)]
    texts += [" ".join(rng.choice(parts[:2] + parts[4:8]) for _ in range(20)) + "\n" + "x y" for _ in range(50)]
    untouched = Tokenizer.from_file(PATH)
    enc = token_files.LibraryEncoder(PATH, cache_size=40)
    plain = [np.array(e.ids, enc.dtype).tobytes() for e in untouched.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == plain and [enc.encode([t])[0] for t in texts[:60]] == plain[:60]
