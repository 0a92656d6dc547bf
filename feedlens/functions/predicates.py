"""Reusable row predicates over the signal schema (JVM-side Column expressions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.schema import MOBILE_SOURCE_PATTERNS


def is_mobile(source: str | Column = "source") -> Column:
    """Mobile app stores: ``lower(source) LIKE '%appstore%' OR LIKE '%google%play%'``.

    'Google Play' matches; 'App Store' (with a space) does not.
    """
    s = F.lower(F.col(source) if isinstance(source, str) else source)
    return reduce(lambda a, b: a | b, [s.like(p) for p in MOBILE_SOURCE_PATTERNS])


def mobile_parts(source: str = "source") -> list[Column]:
    """The two OR-ed parts of :func:`is_mobile`, for the reference precedence mode."""
    s = F.lower(F.col(source))
    return [s.like(p) for p in MOBILE_SOURCE_PATTERNS]


def is_churning(action: str = "customer_action") -> Column:
    """``customer_action LIKE 'churning%'`` with SQLite's ASCII case-insensitive LIKE."""
    return F.col(action).ilike("churning%")


def flag(cond: Column) -> Column:
    """1 when ``cond`` is true, else 0 (NULL counts as 0), as bigint."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
