"""Bound sinks, the stream with two outputs from one read, and the running report."""

import pytest
from pyspark.sql import functions as F

import riskprice as rp
from riskprice.operators import portfolio as pf
from riskprice.operators.publish import children
from riskprice.sources import files, tables
from riskprice.streaming import (latest_distribution, latest_grid, latest_report, read_batches, reports, start_checked_stream,
                                 start_pricing_stream, start_report_stream)

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, (r.asDict(recursive=True) for r in df.select(*sorted(df.columns)).collect())))


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("feed") / "f")
    f = tables.facilities(spark, SF, spoiled=True)
    files.write(f.repartition(4), folder)
    return folder, f


def lose_last_commit(checkpoint):
    """As when a driver dies after a batch is written and before it is committed."""
    import os
    last = max(int(n) for n in os.listdir(checkpoint + "/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")


def test_priced_and_rejected_add_up_after_every_batch(spark, feed, tmp_path):
    folder, f = feed
    sink, checkpoint = str(tmp_path / "sink"), str(tmp_path / "ck")
    start_checked_stream(spark, folder, sink, checkpoint, available_now=True, max_files_per_trigger=1).awaitTermination(300)
    ok, bad = rp.split_facilities(f)
    priced, rejected = read_batches(spark, sink), read_batches(spark, sink, accepted=False)
    want = rp.price_facilities(ok)
    assert rows(priced.drop("batch")) == rows(want)
    assert rows(rejected.select(*bad.columns)) == rows(bad)
    per_file = sorted(r["n"] for r in spark.read.parquet(folder).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect())
    both = priced.select("batch").unionByName(rejected.select("batch")).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in both) == per_file and len(per_file) == 4


def test_a_batch_reads_its_source_once(spark, portfolio, tmp_path, monkeypatch):
    from riskprice.streaming import pricing
    folder, sink = str(tmp_path / "feed"), str(tmp_path / "sink")
    files.write(portfolio, folder)
    seen, plain = spark.sparkContext.accumulator(0), pricing.file_stream
    counted = F.udf(lambda x: (seen.add(1), x)[1], "string").asNondeterministic()
    monkeypatch.setattr(pricing, "file_stream", lambda *a: plain(*a).withColumn("borrower_name", counted("borrower_name")))
    start_checked_stream(spark, folder, sink, str(tmp_path / "ck"), available_now=True).awaitTermination(300)
    assert read_batches(spark, sink).count() == 8 and seen.value == 8


def test_a_replayed_batch_writes_the_same_again(spark, portfolio, tmp_path):
    folder, sink, ck = str(tmp_path / "feed"), str(tmp_path / "sink"), str(tmp_path / "ck")
    files.write(portfolio.repartition(2), folder)
    start_checked_stream(spark, folder, sink, ck, available_now=True, max_files_per_trigger=1).awaitTermination(300)
    lose_last_commit(ck)
    start_checked_stream(spark, folder, sink, ck, available_now=True, max_files_per_trigger=1).awaitTermination(300)
    assert read_batches(spark, sink).count() == 8


@pytest.mark.parametrize("start", [start_pricing_stream, start_checked_stream, start_report_stream])
def test_foreign_checkpoints_are_refused(spark, portfolio, tmp_path, start):
    folder = str(tmp_path / "feed")
    files.write(portfolio, folder)
    one, two = [(str(tmp_path / f"sink{i}"), str(tmp_path / f"ck{i}")) for i in (1, 2)]
    for sink, ck in (one, two):
        start(spark, folder, sink, ck, available_now=True).awaitTermination(300)
    for sink, ck in ((one[0], two[1]), (two[0], one[1]), (one[0], str(tmp_path / "new")), (str(tmp_path / "empty"), one[1])):
        with pytest.raises(ValueError, match="another checkpoint"):
            start(spark, folder, sink, ck, available_now=True)
    start(spark, folder, *one, available_now=True).awaitTermination(300)


def test_a_start_killed_between_the_two_ids_can_be_bound(spark, tmp_path):
    from riskprice.operators.publish import replace_text
    from riskprice.streaming import bind
    sink, ck = str(tmp_path / "sink"), str(tmp_path / "ck")
    replace_text(spark, f"{ck}/_sink_id", "abc")
    assert bind(spark, sink, ck) == "abc" == bind(spark, sink, ck)


def check_report(spark, sink, seen):
    want = pf.portfolio_report(rp.price_facilities(seen))
    assert rows(latest_report(spark, sink)) == rows(want)
    other = pf.portfolio_report(rp.price_facilities(seen, "score_based", "industry"))
    assert rows(latest_report(spark, sink, "score_based", "industry")) == rows(other)
    assert rows(latest_grid(spark, sink)) == rows(rp.model_grid(seen))
    assert rows(latest_distribution(spark, sink)) == rows(rp.model_grid_distribution(seen))


def test_the_running_report_equals_the_batch_jobs(spark, tmp_path):
    """After every start, a replay and compactions."""
    folder, sink, ck = str(tmp_path / "feed"), str(tmp_path / "sink"), str(tmp_path / "ck")
    f = tables.facilities(spark, SF, spoiled=True)
    start = lambda: start_report_stream(spark, folder, sink, ck, available_now=True, compact_every=2,
                                        max_files_per_trigger=1).awaitTermination(300)
    files.write(f.where("loan_term <= 5").repartition(3), folder, mode="append")
    start()
    check_report(spark, sink, rp.split_facilities(f.where("loan_term <= 5"))[0])
    lose_last_commit(ck)
    files.write(f.where("loan_term > 5").repartition(2), folder, mode="append")
    start()
    check_report(spark, sink, rp.split_facilities(f)[0])
    assert len(children(spark, f"{sink}/partials")) < 5             # merged partials are gone


def test_a_replay_of_a_merged_epoch_adds_nothing(spark, portfolio, tmp_path):
    sink = str(tmp_path / "sink")
    for epoch in range(3):
        reports.write_epoch(portfolio, epoch, sink, compact_every=3)
    before = rows(latest_grid(spark, sink))
    for epoch in (2, 0):
        reports.write_epoch(portfolio, epoch, sink, compact_every=3)
    assert rows(latest_grid(spark, sink)) == before
    assert latest_grid(spark, sink).first().facility_count == 3 * 8
    with pytest.raises(ValueError, match="no epoch"):
        latest_grid(spark, str(tmp_path / "none"))
