"""Exact rounding of count ratios.

The reference rounds ratios of counts to one decimal (half-even in Python,
half-away-from-zero in SQLite).  Rounding a binary double at a tie gives
engine-dependent answers, so ratios of non-negative integers are rounded here
on the exact rational value with integer division and remainder; the result
is identical in every engine (see :func:`ratio_round_sql` for the SQL twin).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_dec(c: Column | int) -> Column:
    c = c if isinstance(c, Column) else F.lit(c)
    return c.cast("decimal(38,0)")


def ratio_units(num: Column, den: Column, scale: int = 10,
                half_even: bool = True) -> Column:
    """round(num / den * scale) as a long, exact on the rational value.

    ``num`` >= 0 and ``den`` > 0; NULL when ``den`` is 0 or NULL.
    """
    n = _as_dec(num) * F.lit(scale).cast("decimal(38,0)")
    d = F.when(_as_dec(den) > 0, _as_dec(den))  # NULL instead of a zero divisor
    q = ((n - (n % d)) / d).cast("decimal(38,0)")
    r = n % d
    up = (r * 2 > d) | ((r * 2 == d) & ((q % 2 == 1) if half_even else F.lit(True)))
    return (q + F.when(up, 1).otherwise(0)).cast("bigint")


def ratio_round(num: Column, den: Column, digits: int = 1,
                half_even: bool = True, empty: float | None = 0.0) -> Column:
    """round(num / den, digits) as a double; ``empty`` when den is 0."""
    scale = 10 ** digits
    units = ratio_units(num, den, scale, half_even)
    out = units.cast("double") / float(scale)
    return F.coalesce(out, F.lit(empty).cast("double")) if empty is not None else out


def pct_round(num: Column, den: Column, digits: int = 1,
              half_even: bool = True) -> Column:
    """round(num / den * 100, digits); 0.0 when den is 0."""
    scale = 10 ** digits
    units = ratio_units(_as_dec(num) * 100, den, scale, half_even)
    return F.coalesce(units.cast("double") / float(scale), F.lit(0.0))


# --------------------------------------------------------------------------
# SQL twins (DuckDB / ANSI) used by the oracle queries
# --------------------------------------------------------------------------

def ratio_units_sql(num: str, den: str, scale: int = 10, half_even: bool = True) -> str:
    n = f"(CAST({num} AS HUGEINT) * {scale})"
    d = f"CAST({den} AS HUGEINT)"
    q = f"({n} // NULLIF({d}, 0))"
    r = f"({n} % NULLIF({d}, 0))"
    tie = f"(2 * {r} = {d} AND {q} % 2 = 1)" if half_even else f"(2 * {r} = {d})"
    return f"CAST({q} + CASE WHEN 2 * {r} > {d} OR {tie} THEN 1 ELSE 0 END AS BIGINT)"


def pct_round_sql(num: str, den: str, digits: int = 1, half_even: bool = True) -> str:
    scale = 10 ** digits
    units = ratio_units_sql(f"({num}) * 100", den, scale, half_even)
    return f"COALESCE(CAST({units} AS DOUBLE) / {float(scale)}, 0.0)"


def ratio_round_sql(num: str, den: str, digits: int = 1, half_even: bool = True) -> str:
    scale = 10 ** digits
    units = ratio_units_sql(num, den, scale, half_even)
    return f"COALESCE(CAST({units} AS DOUBLE) / {float(scale)}, 0.0)"


# --------------------------------------------------------------------------
# numpy-style rounding of doubles (what pandas ``Series.round`` does):
# rint(x * 10**d) / 10**d, rint being round-half-even on the double.
# --------------------------------------------------------------------------

def numpy_round(c: Column, digits: int = 1) -> Column:
    if digits == 0:
        return F.rint(c)
    scale = float(10 ** digits)
    return F.rint(c * scale) / scale


def numpy_round_sql(expr: str, digits: int = 1) -> str:
    scale = float(10 ** digits)
    y = f"(({expr}) * {scale})" if digits else f"({expr})"
    fl = f"floor({y})"
    r = (f"(CASE WHEN {y} - {fl} > 0.5 THEN {fl} + 1 WHEN {y} - {fl} < 0.5 THEN {fl} "
         f"WHEN {fl} % 2 = 0 THEN {fl} ELSE {fl} + 1 END)")
    return f"({r} / {scale})" if digits else r
