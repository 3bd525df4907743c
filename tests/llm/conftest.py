import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, h long, parts string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """(doc_id, text) pairs as a documents table with further columns, some named like
    columns that operators use."""
    def make(rows, partitions=3):
        full = [(i, t, "en", "src0", None if t is None else len(t), 1.0, -1, -1, "x") for i, t in rows]
        return spark.createDataFrame(full, DDL).repartition(partitions)
    return make


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and white texts, ties, repeated rows, copies, a long text."""
    rng = random.Random(7)
    passage, long = words(rng, 70), words(rng, 6000, 10**6)
    rows = [(0, None), (1, ""), (2, " \n\t "), (None, "no id " + words(rng, 30)), (None, None), (3, "one"), (4, "Two Words")]
    rows += [(10 + i, words(rng, 40)) for i in range(6)]
    rows += [(30, words(rng, 20) + " " + passage + "\n" + words(rng, 15)), (31, words(rng, 5) + " " + passage), (32, passage)]
    rows += [(40, long), (41, long), (41, long), (42, long + " end"), (43, long.upper())]
    rows += [(50, "é ü 東京 😀 " + words(rng, 30)), (51, "a\x0bb\x0cc\rd \x85e f\n" * 3)]
    return rows
