"""Row-level input rules: split a feed into accepted and quarantined rows.

A rule passes only when its condition is TRUE: a null (or NaN) value fails it.
The names of the failed rules are joined into ``validation_errors``; rows with
an empty list are accepted. Both sides come from one narrow projection, so a
split never shuffles.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass
from typing import List, Optional, Sequence, Tuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import compiled_apart
from ..schemas import CORRUPT


@dataclass(frozen=True)
class Rule:
    column: str
    lo: Optional[float] = None          # lower bound (inclusive unless lo_open)
    hi: Optional[float] = None          # upper bound (inclusive)
    lo_open: bool = False
    double: bool = False                # NaN fails for double columns

    @property
    def name(self) -> str:
        ranged = self.lo is not None or self.hi is not None
        return f"{self.column}_{'range' if ranged else 'required'}"

    def condition(self) -> Column:
        """True where the value passes; false or null where it does not (a null value makes
        every comparison null)."""
        c = F.col(self.column)
        if self.lo is None and self.hi is None:
            return c.isNotNull()
        parts = []
        if self.lo is not None:
            parts.append((c > F.lit(self.lo)) if self.lo_open else (c >= F.lit(self.lo)))
        if self.hi is not None:
            parts.append(c <= F.lit(self.hi))
        elif self.double:                       # NaN is above every number, so only an upper bound stops it
            parts.append(~F.isnan(c))
        return functools.reduce(operator.and_, parts)


# FIXED VALUES: accepted domain of each input column.
PRODUCT_RULES: Tuple[Rule, ...] = (
    Rule("product_id"), Rule("name"), Rule("category"),
    Rule("cost", lo=0, lo_open=True, double=True),
    Rule("quantity", lo=0, lo_open=True),
)

FACILITY_RULES: Tuple[Rule, ...] = (
    Rule("borrower_id"), Rule("borrower_name"),
    Rule("credit_score", lo=300, hi=850),
    Rule("debt_to_income", lo=0, hi=2, double=True),
    Rule("loan_to_value", lo=0, hi=1.5, double=True),
    Rule("employment_years", lo=0),
    Rule("payment_history_score", lo=0, hi=100),
    Rule("industry"), Rule("company_size"), Rule("collateral_type"),
    Rule("seniority"), Rule("facility_type"),
    Rule("exposure_amount", lo=0, lo_open=True, double=True),
    Rule("outstanding_amount", lo=0, double=True),
    Rule("undrawn_amount", lo=0, double=True),
    Rule("loan_term", lo=0, lo_open=True),
    Rule("region"),
)
# end of fixed values


def _checks(rules: Sequence[Rule], columns: Sequence[str], absent_ok: Sequence[str]) -> List[Tuple[str, Column]]:
    """(name, condition) of each rule, which passes where the condition is true. A rule whose column the
    feed lacks fails every row as '<column>_missing', unless the column may be absent. A
    row that could not be read fails as 'unreadable'."""
    out: List[Tuple[str, Column]] = []
    if CORRUPT in columns:
        out.append(("unreadable", F.col(CORRUPT).isNull()))
    for r in rules:
        if r.column in columns:
            out.append((r.name, r.condition()))
        elif r.column not in absent_ok:
            out.append((f"{r.column}_missing", F.lit(False)))
    return out


def errors_column(rules: Sequence[Rule], columns: Sequence[str], absent_ok: Sequence[str] = ()) -> Column:
    """Comma-joined names of failed rules ('' when the row is valid)."""
    return F.concat_ws(",", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in _checks(rules, columns, absent_ok)])


def valid_row(rules: Sequence[Rule], columns: Sequence[str], absent_ok: Sequence[str] = ()) -> Column:
    """True where no rule fails, else false or null; nothing is named. A plain conjunction,
    so its parts reach the scan and Spark knows the columns behind it to be set."""
    checks = [ok for _, ok in _checks(rules, columns, absent_ok)]
    return functools.reduce(operator.and_, checks) if checks else F.lit(True)


def with_errors(df: DataFrame, rules: Sequence[Rule], absent_ok: Sequence[str] = ()) -> DataFrame:
    return df.withColumns({"validation_errors": errors_column(rules, df.columns, absent_ok)})


def split(df: DataFrame, rules: Sequence[Rule], absent_ok: Sequence[str] = ()) -> Tuple[DataFrame, DataFrame]:
    """(valid rows with the original columns, rejected rows + validation_errors). Rules are
    plain conditions in both filters; their names are joined for rejected rows only."""
    ok = valid_row(rules, df.columns, absent_ok)
    rejected = compiled_apart(df.filter(~F.coalesce(ok, F.lit(False))), df.columns[0])
    return df.filter(ok).drop(CORRUPT), with_errors(rejected, rules, absent_ok)


def split_products(df: DataFrame) -> Tuple[DataFrame, DataFrame]:
    return split(df, PRODUCT_RULES)


def split_facilities(df: DataFrame, absent_ok: Sequence[str] = ()) -> Tuple[DataFrame, DataFrame]:
    """``absent_ok``: columns that the feed may lack altogether (``schemas.ABSENT_OK`` for a
    feed whose formulas then use their fallbacks)."""
    return split(df, FACILITY_RULES, absent_ok)
