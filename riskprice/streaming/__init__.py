"""Structured Streaming jobs: the pricing chain is stateless and row-local, so the
batch operators run unchanged on a stream of arriving files."""

from .pricing import (facility_stream, latest_totals, price_stream, running_totals, start_pricing_stream,
                      start_product_stream, start_rejects_stream, start_totals_stream)
from .reports import latest_distribution, latest_grid, latest_report, start_report_stream
from .sinks import bind, read_batches, start_checked_stream

__all__ = ["bind", "facility_stream", "latest_distribution", "latest_grid", "latest_report", "latest_totals", "price_stream",
           "read_batches", "running_totals", "start_checked_stream", "start_pricing_stream", "start_product_stream",
           "start_rejects_stream", "start_report_stream", "start_totals_stream"]
