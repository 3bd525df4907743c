import hashlib
import re

import pytest

import corpus_pipeline
from riskprice.llm import bpe, common, queries
from test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = common.table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        new = common.store(stage(spark, docs, SF))
        out.append((name, docs.collect(), new.collect(), new.columns))
        docs = new
    return out


def test_stages_in_order(outputs):
    assert [x[0] for x in outputs] == ["toxicity", "simhash", "decontamination", "pii", "encoding"]
    for _, before, after, columns in outputs[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"] and len(after) <= len(before)


def test_toxicity_stage_matches_its_operator(spark, outputs):
    _, before, after, _ = outputs[0]
    kept = {r.doc_id for r in queries.op1_toxicity(spark, SF).collect() if r.predicted == 0}
    assert {r.doc_id for r in after} == kept and set(after) <= set(before)


def test_near_duplicate_stage(outputs):
    _, before, after, _ = outputs[1]
    fp = {r.doc_id: plain_fingerprint(r.text) for r in before}
    group = plain_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    assert {r.doc_id for r in after} == {i for i in fp if group[i] == i}


def test_pii_stage(outputs):
    _, before, after, _ = outputs[3]
    old = {r.doc_id: r.text for r in before}
    assert sorted(old) == sorted(r.doc_id for r in after)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert any(email.search(t) for t in old.values()) and not any(email.search(r.text) for r in after)
    personal = re.compile(r"[0-9]{2}|@")
    assert all(r.text == old[r.doc_id] for r in after if not personal.search(old[r.doc_id]))


def test_encoding_stage(outputs):
    _, before, after, _ = outputs[4]
    enc, got = bpe.encoder(queries.TIKTOKEN_RANKS), {r.doc_id: r for r in after}
    for r in before:
        pieces, _ = next(bpe.encode_batch([r.text.encode()], enc))
        ids = [i for p in pieces for i in p]
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_run_equals_the_stages(spark, outputs):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, outputs[-1][2]))


def test_edges_through_all_stages(spark, make_docs, edge_rows):
    """Nulls, empty and long texts, repeated rows and ids, columns named like those that
    operators use: every filtering stage keeps the columns and rows of its input."""
    docs = make_docs(edge_rows + [(80, "write to ann@x.org or +1 (555) 867-5309 " + "now " * 30), (None, None)])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = common.store(stage(spark, docs, SF))
        assert new.columns == columns, name
        if name != "pii":
            assert new.exceptAll(docs).count() == 0, name                 # rows go or stay, none is changed
        else:
            assert new.count() == docs.count() and new.where("text RLIKE '@'").count() == 0
        docs = new
    kept = {r.doc_id for r in docs.collect()}
    assert {40, 32, 80, 50, None} <= kept and not {41, 42, 43} & kept and len([r for r in docs.collect() if r.doc_id is None]) >= 2
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(encoded) == docs.count() and all(r.n_tokens >= 0 for r in encoded)


def test_empty_documents(spark, make_docs):
    docs = make_docs([(1, "x")]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, SF)
        assert new.count() == 0, name
        docs = docs if name == "encoding" else new
