"""Reporting precision of registered query outputs.

Engines agree bit for bit on + - * / evaluated in the same order, but not on
``exp`` (last-bit differences between the JVM and C libraries) nor on floating
sums, whose order depends on partitioning. Query outputs therefore report
doubles on a fixed decimal grid using ``rint(x * s) / s``: the same IEEE steps in
every engine and at every size (unlike ``round``, whose algorithm differs).
"""

from __future__ import annotations

import sys
from typing import Iterable, Tuple

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType

from ..functions.columns import compiled_apart, quoted

MONEY = frozenset({
    "exposure_amount", "outstanding_amount", "undrawn_amount", "ead_amount",
    "regulatory_capital", "economic_capital", "expected_loss", "funding_cost",
    "operational_cost", "interest_revenue", "fee_revenue", "total_revenue", "net_income",
    "required_revenue", "stress_expected_loss", "cost", "base_price", "final_price",
    "total_exposure", "total_expected_loss", "total_economic_capital", "total_net_income",
    "average_price", "max_price", "min_price",
})

# (money grid, other grid) for row-level outputs and for aggregates.
ROW_GRID: Tuple[float, float] = (1e6, 1e10)
AGG_GRID: Tuple[float, float] = (1e2, 1e9)


MAX_DOUBLE = sys.float_info.max


def grid_for(name: str, grid: Tuple[float, float]) -> float:
    return grid[0] if name in MONEY else grid[1]


def report(df: DataFrame, grid: Tuple[float, float] = ROW_GRID) -> DataFrame:
    """Every double column on its reporting grid; other columns untouched. The grid gives the
    nearest multiple of 1 / scale, ties to the even one. NaN, infinities and what the scale
    would take out of the range of doubles stay as they are."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)]
    for at in range(0, len(doubles), AT_ONCE):
        df = compiled_apart(df, df.columns[0])
        part = set(doubles[at:at + AT_ONCE])
        df = df.selectExpr(*[_on_grid(quoted(c), grid_for(c, grid)) if c in part else quoted(c) for c in df.columns])
    return df


AT_ONCE = 12            # columns of a compiled method


def _on_grid(name: str, scale: float) -> str:
    s = sql_num(scale)
    return f"IF(abs({name} * {s}) <= {sql_num(MAX_DOUBLE)}, rint({name} * {s}) / {s}, {name}) AS {name}"


def sql_num(x: float) -> str:
    """A DOUBLE literal (scientific notation is DOUBLE, plain decimals are DECIMAL)."""
    s = repr(float(x))
    return s if "e" in s else s + "e0"


def sql_on_grid(expr: str, scale: float) -> str:
    return (f"CASE WHEN abs(({expr}) * {sql_num(scale)}) <= {sql_num(MAX_DOUBLE)} "
            f"THEN round_even(({expr}) * {sql_num(scale)}, 0) / {sql_num(scale)} ELSE {expr} END")


def sql_select(columns: Iterable[Tuple[str, bool]], grid: Tuple[float, float] = ROW_GRID,
               source: str = "") -> str:
    """SELECT list for (name, is_double) pairs with the same reporting grid."""
    parts = []
    for name, is_double in columns:
        ref = f"{source}{name}"
        parts.append(f"{sql_on_grid(ref, grid_for(name, grid))} AS {name}" if is_double
                     else f"{ref} AS {name}" if source else name)
    return ", ".join(parts)
