"""Streaming pricing equals batch pricing; running totals equal the batch summary."""

import tempfile

import pytest

import riskprice as rp
from riskprice.sources import files, tables
from riskprice.streaming import (latest_totals, start_pricing_stream, start_product_stream, start_rejects_stream,
                                 start_totals_stream)


@pytest.fixture(scope="module")
def feed(spark):
    src = tempfile.mkdtemp(prefix="rp-stream-src-")
    f = tables.facilities(spark, "/root/testdata/sf0.001")
    files.write(f.repartition(3), src, mode="overwrite")
    return src, f


def test_stream_equals_batch(spark, feed):
    src, f = feed
    sink = tempfile.mkdtemp(prefix="rp-stream-out-")
    ckpt = tempfile.mkdtemp(prefix="rp-stream-ckpt-")
    q = start_pricing_stream(spark, src, sink, checkpoint=ckpt, available_now=True,
                             pd_model="score_based", lgd_model="hybrid", max_files_per_trigger=1)
    q.awaitTermination(300)
    streamed = spark.read.parquet(sink)
    batch = rp.price_facilities(f, "score_based", "hybrid")
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0


def test_running_totals(spark, feed):
    src, f = feed
    sink = tempfile.mkdtemp(prefix="rp-totals-out-")
    ckpt = tempfile.mkdtemp(prefix="rp-totals-ckpt-")
    q = start_totals_stream(spark, src, sink + "/t", checkpoint=ckpt, available_now=True,
                            max_files_per_trigger=1)
    q.awaitTermination(300)
    got = latest_totals(spark, sink + "/t").first().asDict()
    epochs = [r.epoch_id for r in spark.read.parquet(sink + "/t").select("epoch_id").distinct().collect()]
    assert 1 <= len(epochs) <= 3
    want = rp.portfolio_summary(rp.price_facilities(f)).first().asDict()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9), k


def test_new_checkpoint_on_a_used_sink_is_refused(spark, feed):
    """The sink would skip the batches whose numbers it has seen, so rows would be lost."""
    src, f = feed
    sink, ckpt = tempfile.mkdtemp(prefix="rp-bind-out-"), tempfile.mkdtemp(prefix="rp-bind-ckpt-")
    start_pricing_stream(spark, src, sink, checkpoint=ckpt, available_now=True).awaitTermination(300)
    with pytest.raises(ValueError, match="another checkpoint"):
        start_pricing_stream(spark, src, sink, checkpoint=ckpt + "-new", available_now=True)
    start_pricing_stream(spark, src, sink, checkpoint=ckpt, available_now=True).awaitTermination(300)
    assert spark.read.parquet(sink).count() == f.count()


def test_stream_quarantines(spark, portfolio):
    """JSON stream with mistyped, unreadable and negative rows: priced + rejected = input."""
    import json
    src, out = tempfile.mkdtemp(prefix="rp-bad-src-"), tempfile.mkdtemp(prefix="rp-bad-out-")
    rows = [json.loads(r) for r in portfolio.toJSON().collect()]
    rows += [{**rows[0], "borrower_id": "X1", "loan_to_value": "bad"}, {**rows[0], "borrower_id": "X2", "credit_score": "n/a"},
             {**rows[0], "borrower_id": "X3", "outstanding_amount": -100.0}]
    with open(src + "/a.json", "w") as fh:
        fh.write("\n".join(map(json.dumps, rows)) + "\n{broken\n")
    for start, name in ((start_pricing_stream, "rows"), (start_rejects_stream, "rejected")):
        start(spark, src, f"{out}/{name}", checkpoint=f"{out}/ckpt-{name}", available_now=True, fmt="json",
              columns=portfolio.columns).awaitTermination(300)
    assert spark.read.parquet(out + "/rows").count() == 8 and spark.read.parquet(out + "/rejected").count() == 4


def test_product_stream(spark, products):
    from pyspark.sql import functions as F
    src, out = tempfile.mkdtemp(prefix="rp-prod-src-"), tempfile.mkdtemp(prefix="rp-prod-out-")
    files.write(products.withColumn("quantity", F.when(F.col("product_id") == "P003", 0).otherwise(F.col("quantity"))), src)
    start_product_stream(spark, src, out + "/rows", checkpoint=out + "/ckpt", available_now=True).awaitTermination(300)
    got = {r.product_id: r.final_price for r in spark.read.parquet(out + "/rows").collect()}
    assert got == {"P001": 180.0, "P002": 106.875, "P004": 216.0, "P005": 32.4}


def test_stream_checkpoint_defaults_to_session_dir(spark, feed):
    from riskprice.streaming.pricing import default_checkpoint
    a = default_checkpoint(spark, "q", "/in/a", "/out/a")
    assert a.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert a != default_checkpoint(spark, "q", "/in/b", "/out/a")


def test_restart_from_checkpoint_is_exactly_once(spark):
    """Stop after the first files, add more, restart on the same checkpoint: every
    facility is priced exactly once (file source offsets + file sink log)."""
    f = tables.facilities(spark, "/root/testdata/sf0.001")
    src = tempfile.mkdtemp(prefix="rp-restart-src-")
    sink = tempfile.mkdtemp(prefix="rp-restart-out-")
    ckpt = tempfile.mkdtemp(prefix="rp-restart-ckpt-")
    first, second = f.filter("loan_term <= 7"), f.filter("loan_term > 7")
    files.write(first.repartition(2), src + "/a")
    q = start_pricing_stream(spark, src + "/*", sink, checkpoint=ckpt, available_now=True)
    q.awaitTermination(300)
    n1 = spark.read.parquet(sink).count()
    assert n1 == first.count()
    files.write(second.repartition(2), src + "/b")
    q = start_pricing_stream(spark, src + "/*", sink, checkpoint=ckpt, available_now=True)
    q.awaitTermination(300)
    out = spark.read.parquet(sink)
    batch = rp.price_facilities(f)
    assert out.count() == f.count()
    assert out.select("borrower_id").distinct().count() == f.count()
    assert out.exceptAll(batch.select(*out.columns)).count() == 0


def test_unset_checkpoint_dir_is_an_error_on_a_cluster(monkeypatch):
    from riskprice import session

    class Conf:
        def get(self, key, default=None):
            return default

    class FakeSession:
        conf = Conf()

    monkeypatch.setattr(session, "_is_local", lambda spark: False)
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(FakeSession())
