"""Batch and streaming jobs for spark-submit.

    spark-submit -m riskprice.cli price-facilities --input s3://.../facilities --output s3://.../priced
    python -m riskprice.cli model-grid --input feed/ --output grid/

The session comes from the submitting environment (``getOrCreate``); every job
reads with explicit types, checks the rows, prices the valid ones, writes the others
beside them with their errors, and returns only one-row summaries to the driver.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from typing import List, Optional

from pyspark.sql import SparkSession

from . import params as P
from .functions import registry
from .operators import jobs, model_grid, portfolio, publish, quality
from .schemas import ABSENT_OK
from .sources import feeds, files


def _risk_params(a) -> P.RiskParams:
    return P.RiskParams(risk_type=a.risk_type, target_raroc=a.target_raroc,
                        competitive_margin=a.competitive_margin,
                        stress_pd_factor=a.stress_pd_factor, stress_lgd_factor=a.stress_lgd_factor,
                        economic_condition=a.economic_condition, stress_factor=a.stress_factor)


def _add_risk_args(p: argparse.ArgumentParser) -> None:
    d = P.RiskParams()
    p.add_argument("--models", metavar="MODULE", help="module that registers models of your own")
    p.add_argument("--pd-model", default="logistic")
    p.add_argument("--lgd-model", default="hybrid")
    p.add_argument("--risk-type", default=d.risk_type)
    p.add_argument("--target-raroc", type=float, default=d.target_raroc)
    p.add_argument("--competitive-margin", type=float, default=d.competitive_margin)
    p.add_argument("--stress-pd-factor", type=float, default=d.stress_pd_factor)
    p.add_argument("--stress-lgd-factor", type=float, default=d.stress_lgd_factor)
    p.add_argument("--economic-condition", default=d.economic_condition)
    p.add_argument("--stress-factor", type=float, default=d.stress_factor)
    p.add_argument("--columns", nargs="*", default=None,
                   help="columns that the feed has (looked up when omitted; required for streams)")


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="riskprice")
    sub = ap.add_subparsers(dest="job", required=True)
    for name in ("price-facilities", "publish-facilities", "model-grid", "split-facilities", "stream-facilities",
                 "stream-rejects", "stream-totals", "stream-checked", "stream-report"):
        p = sub.add_parser(name)
        p.add_argument("--input", required=True)
        p.add_argument("--format", default="parquet", choices=files.FORMATS)
        p.add_argument("--output", required=True)
        _add_risk_args(p)
        if name.startswith("stream-"):
            p.add_argument("--checkpoint")
            p.add_argument("--available-now", action="store_true")
            p.add_argument("--interval", default="1 minute")
    for name in ("price-products", "publish-products", "split-products", "stream-products"):
        p = sub.add_parser(name)
        p.add_argument("--input", required=True)
        p.add_argument("--format", default="parquet", choices=files.FORMATS)
        p.add_argument("--output", required=True)
        for f, default in vars(P.ProductRules()).items():
            p.add_argument("--" + f.replace("_", "-"), type=type(default), default=default)
        if name.startswith("stream-"):
            p.add_argument("--checkpoint")
            p.add_argument("--available-now", action="store_true")
            p.add_argument("--interval", default="1 minute")
    return ap


def run(argv: Optional[List[str]] = None, spark: Optional[SparkSession] = None) -> dict:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"riskprice-{a.job}").getOrCreate()
    out: dict = {"job": a.job, "output": a.output}
    if a.job.endswith("-products"):
        rules = P.ProductRules(**{f: getattr(a, f) for f in vars(P.ProductRules())})
        if a.job == "stream-products":
            from .streaming import start_product_stream
            start_product_stream(spark, a.input, a.output, checkpoint=a.checkpoint, available_now=a.available_now,
                                 interval=a.interval, fmt=a.format, rules=rules).awaitTermination()
            return out
        feed = files.read_products(spark, a.input, a.format, keep_unreadable=True)
        if a.job == "publish-products":
            return {**out, **publish.publish_products(feed, a.output, rules)}
        if a.job == "split-products":
            jobs.split_and_write(feed, quality.PRODUCT_RULES, a.output)
            return out
        rejected = jobs.price_products_checked(feed, a.output, rules)
        written = spark.read.parquet(a.output + "/rows")
        out["summary"] = {**portfolio.product_summary(written).first().asDict(), "rejected_count": rejected}
        return out
    rp = _risk_params(a)
    if a.models:
        importlib.import_module(a.models)
    registry.PD.check(a.pd_model)
    registry.LGD.check(a.lgd_model)
    if a.job.startswith("stream-"):
        from .streaming import (start_checked_stream, start_pricing_stream, start_rejects_stream, start_report_stream,
                                start_totals_stream)
        if a.columns is None:
            raise ValueError("a stream needs --columns: the columns that its files have")
        start = {"stream-facilities": start_pricing_stream, "stream-rejects": start_rejects_stream,
                 "stream-totals": start_totals_stream, "stream-checked": start_checked_stream,
                 "stream-report": start_report_stream}[a.job]
        models = {} if a.job == "stream-report" else {"pd_model": a.pd_model, "lgd_model": a.lgd_model}
        q = start(spark, a.input, a.output, checkpoint=a.checkpoint,
                  available_now=a.available_now, interval=a.interval,
                  fmt=a.format, rp=rp, columns=a.columns, **models)
        q.awaitTermination()
        return out
    if a.job == "publish-facilities":
        read = [files.read_facilities(spark, a.input, a.format, a.columns, keep_unreadable=True)] if a.columns else \
            feeds.facility_feeds(spark, a.input, a.format, keep_unreadable=True)
        return {**out, **publish.publish_facilities(read, a.output, a.pd_model, a.lgd_model, rp)}
    feed = files.read_facilities(spark, a.input, a.format, a.columns, keep_unreadable=True)
    if a.job == "split-facilities":
        jobs.split_and_write(feed, quality.FACILITY_RULES, a.output, absent_ok=ABSENT_OK)
    elif a.job == "price-facilities":
        out["summary"] = jobs.price_checked(feed, a.output, a.pd_model, a.lgd_model, rp)
        files.write(jobs.written_distributions(spark, a.output + "/rows"), a.output + "/distributions")
        files.write(spark.createDataFrame([out["summary"]]).coalesce(1), a.output + "/summary", "json")
    elif a.job == "model-grid":
        valid, _ = quality.split_facilities(feed, ABSENT_OK)
        files.write(model_grid.model_grid(valid, rp), a.output)
    return out


def main(argv: Optional[List[str]] = None) -> int:
    print(json.dumps(run(argv), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
