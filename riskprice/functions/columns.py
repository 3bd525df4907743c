"""Small expression helpers shared by all models."""

from __future__ import annotations

from typing import Callable, Iterable, Mapping, Sequence, Tuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Resolves the name of an earlier pricing column to an expression: ``F.col`` when the
# column is already materialised, or the defining expression when steps are fused.
Ref = Callable[[str], Column]


def sql_literal(v: object) -> str:
    """SQL text of a literal: strings quoted, numbers as DOUBLE (scientific notation,
    since a plain decimal such as 0.15 would be parsed as DECIMAL)."""
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, bool) or v is None:
        raise TypeError(f"unsupported literal {v!r}")
    if isinstance(v, int):
        return str(v)
    s = repr(float(v))
    return s if "e" in s else s + "e0"


def quoted(name: str) -> str:
    """A column name in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def map_lookup(key_sql: str, card: Mapping, otherwise: object) -> Column:
    """Value of ``card`` at a key expression; an unknown or null key gives ``otherwise``.
    The card is one literal map in the plan: whatever its size, the generated code is the
    same short loop, where a CASE would grow by a branch for each entry."""
    if not card:
        return F.lit(otherwise)
    pairs = ", ".join(f"{sql_literal(k)}{'L' if isinstance(k, int) else ''}, {sql_literal(v)}" for k, v in card.items())
    return F.expr(f"coalesce(map({pairs})[{key_sql}], {sql_literal(otherwise)})")


def lookup(key: str, card: Mapping[str, float], default: float) -> Column:
    """Exact, case-sensitive lookup of input column ``key``."""
    return map_lookup(quoted(key), {k: float(v) for k, v in card.items()}, float(default))


def factor(key: str, card: Mapping[str, float]) -> Column:
    """Multiplier lookup where every other value (and null) is the neutral 1.0."""
    return lookup(key, card, 1.0)


def first_band(value: str, bands: Iterable[Tuple[float, object]], op: str,
               otherwise: object) -> Column:
    """First band whose bound satisfies ``value <op> bound`` wins (CASE order);
    ``value`` names an input column."""
    if op not in (">=", ">", "<="):
        raise ValueError(op)
    v = quoted(value)
    whens = " ".join(f"WHEN {v} {op} {sql_literal(b)} THEN {sql_literal(o)}" for b, o in bands)
    return F.expr(f"CASE {whens} ELSE {sql_literal(otherwise)} END")


def clip_when(x: Column, lo: float, hi: float) -> Column:
    """Cap then floor with CASE: a null input stays null, NaN goes to the cap."""
    return F.when(x > F.lit(hi), F.lit(hi)).when(x < F.lit(lo), F.lit(lo)).otherwise(x)


def cap_then_floor(x: Column, lo: float, hi: float) -> Column:
    """greatest(least(x, hi), lo); least/greatest skip nulls, so null -> hi."""
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def floor_then_cap(x: Column, lo: float, hi: float) -> Column:
    """least(greatest(x, lo), hi); least/greatest skip nulls, so null -> lo."""
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def ratio_or_zero(num: Column, den: Column) -> Column:
    """num / den when den > 0, else 0.0 (division never evaluated on zero)."""
    return F.when(den > F.lit(0), num / den).otherwise(F.lit(0.0))


def ratio_or_null(num: Column, den: Column) -> Column:
    """num / den, NULL on a zero divisor instead of an ANSI error."""
    return F.try_divide(num, den)


def has(columns: Sequence[str], *names: str) -> bool:
    """Plan-time schema check for optional inputs."""
    return all(n in columns for n in names)


def compiled_apart(df: DataFrame, *names: str) -> DataFrame:
    """The same rows; what is behind and what is before are compiled as separate methods.

    Spark writes the code of a whole chain of projections into one method, and the JVM
    runs methods of more than 8,000 bytes interpreted. A generator, however, takes its
    input as arguments of a method of its own. So the columns ``names`` (which whatever
    follows needs) pass through a generator of one element; the row count is kept, and
    other columns that nobody asks for are still pruned."""
    one = F.explode(F.array(F.struct(*names))).alias("_one")
    return df.select(*[c for c in df.columns if c not in names], one) \
             .select(*[F.col(f"_one.{c}") if c in names else c for c in df.columns])
