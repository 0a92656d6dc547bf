"""Filter algebra over signals.

A :class:`SignalFilter` is an immutable value that renders to ONE Spark
``Column`` predicate.  Metrics apply it before aggregating, so Catalyst pushes
it into the Parquet scan (``PushedFilters``) and prunes ``dataset_id``
partitions where it can.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.schema import (
    DEFAULT_YEAR_FROM, DEFAULT_YEAR_TO, TAB_CONFIG,
)

# Filter key -> signal column.
_IN_COLUMNS = {
    "years": "year",
    "months": "month",
    "sources": "source",
    "companies": "company",
    "products": "product_service",
    "actions": "customer_action",
}
# Period mode -> the filter keys that it sets.
PERIOD_MODES = {"rango": ("period",), "anios": ("years",), "anios_meses": ("years", "months")}
# Dimension of a tab -> its filter key.
DIMENSION_KEYS = {"source": "sources", "company": "companies", "product": "products", "action": "actions",
                  "sentiment": "sentiment"}
KEYS = ("period", "years", "months", "sources", "companies", "products",
        "actions", "sentiment")


def _tuple(v) -> tuple | None:
    if v is None:
        return None
    if isinstance(v, (str, int)):
        return (v,)
    t = tuple(v)
    return t or None


@dataclass(frozen=True)
class SignalFilter:
    """Active filters.  Empty / falsy entries are inactive.

    period     (year_from, year_to), inclusive both ends          F1
    years      year IN (...)                                      F2
    months     month IN (...)                                     F3
    sources    source IN (...)                                    F4
    companies  company IN (...)                                   F5
    products   product_service IN (...)                           F6
    actions    customer_action IN (...)                           F7
    sentiment  sentiment_label = lower(value); 'ALL' = off        F8
    """

    period: tuple[int, int] | None = None
    years: tuple[int, ...] | None = None
    months: tuple[int, ...] | None = None
    sources: tuple[str, ...] | None = None
    companies: tuple[str, ...] | None = None
    products: tuple[str, ...] | None = None
    actions: tuple[str, ...] | None = None
    sentiment: str | None = None

    def __post_init__(self):
        for k in ("years", "months", "sources", "companies", "products", "actions"):
            object.__setattr__(self, k, _tuple(getattr(self, k)))
        if self.years:
            object.__setattr__(self, "years", tuple(int(y) for y in self.years))
        if self.months:
            object.__setattr__(self, "months", tuple(int(m) for m in self.months))
        if self.period:
            a, b = self.period
            object.__setattr__(self, "period", (int(a), int(b)))

    # -- construction -----------------------------------------------------
    @classmethod
    def from_dict(cls, d: dict | None) -> "SignalFilter":
        d = d or {}
        return cls(**{k: d.get(k) for k in KEYS})

    @classmethod
    def from_period(cls, mode: str, year_from: int | None = None,
                    year_to: int | None = None, years: Iterable[int] | None = None,
                    months: Iterable[int] | None = None, **others) -> "SignalFilter":
        """a period mode sets the keys that :data:`PERIOD_MODES` lists for it, and no other period key.

        An open end of the range is the default year; an empty list is no filter.
        """
        given = {"period": (year_from or DEFAULT_YEAR_FROM, year_to or DEFAULT_YEAR_TO),
                 "years": years, "months": months}
        return cls(**{key: given[key] for key in PERIOD_MODES.get(mode, ())}, **others)

    def as_dict(self) -> dict:
        return {k: getattr(self, k) for k in KEYS if self._active(k)}

    # -- algebra ----------------------------------------------------------
    def _active(self, key: str) -> bool:
        v = getattr(self, key)
        if key == "sentiment":
            return bool(v) and v != "ALL"
        return bool(v)

    def without(self, *keys: str) -> "SignalFilter":
        """the same filter with some keys switched off."""
        return replace(self, **{k: None for k in keys})

    def for_tab(self, tab: str) -> "SignalFilter":
        """the filter as a stakeholder tab sees it.

        Keys of dimensions that the tab hides are off; of the sources, those
        that the tab offers stay, and without any the source filter is off.
        """
        config = TAB_CONFIG.get(tab)
        if config is None:
            return self
        pruned = self.without(*[key for dim, key in DIMENSION_KEYS.items() if dim not in config["visible"]])
        if pruned.sources and config["sources"]:
            offered = frozenset(config["sources"])
            pruned = replace(pruned, sources=tuple(filter(offered.__contains__, pruned.sources)))
        return pruned

    def conditions(self) -> dict[str, Column]:
        """One predicate per active key (F1-F8)."""
        out: dict[str, Column] = {}
        if self._active("period"):
            a, b = self.period
            out["period"] = F.col("year").between(a, b)
        for key, col in _IN_COLUMNS.items():
            if self._active(key):
                out[key] = F.col(col).isin(list(getattr(self, key)))
        if self._active("sentiment"):
            out["sentiment"] = F.col("sentiment_label") == F.lit(self.sentiment.lower())
        return out

    def sql_conditions(self) -> dict[str, str]:
        """The same predicates as SQL text (for oracle queries and logs)."""
        def lit(v):
            return str(int(v)) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

        out: dict[str, str] = {}
        if self._active("period"):
            a, b = self.period
            out["period"] = f"year BETWEEN {a} AND {b}"
        for key, col in _IN_COLUMNS.items():
            if self._active(key):
                out[key] = f"{col} IN ({', '.join(lit(v) for v in getattr(self, key))})"
        if self._active("sentiment"):
            out["sentiment"] = f"sentiment_label = {lit(self.sentiment.lower())}"
        return out

    def sql(self) -> str:
        return " AND ".join(self.sql_conditions().values())

    def predicate(self) -> Column | None:
        """conjunction of the active predicates; None when nothing is active.

        A NULL column value never passes an active filter (a NULL predicate
        is not true).
        """
        conds = list(self.conditions().values())
        if not conds:
            return None
        return reduce(lambda a, b: a & b, conds)

    def apply(self, df: DataFrame) -> DataFrame:
        p = self.predicate()
        return df if p is None else df.where(p)


NO_FILTER = SignalFilter()


def as_filter(f: SignalFilter | dict | None) -> SignalFilter:
    if f is None:
        return NO_FILTER
    if isinstance(f, SignalFilter):
        return f
    return SignalFilter.from_dict(f)


def apply_filter(sig: DataFrame, f: SignalFilter | dict | None,
                 base: Column | None = None) -> DataFrame:
    """``base AND filters`` (parenthesised)."""
    pred = as_filter(f).predicate()
    conds = [c for c in (base, pred) if c is not None]
    if not conds:
        return sig
    return sig.where(reduce(lambda a, b: a & b, conds))


def apply_filter_reference_precedence(sig: DataFrame, f: SignalFilter | dict | None,
                                      first: Column, second: Column) -> DataFrame:
    """The reference's splice of ``A OR B`` with filters: ``A OR (B AND filters)``.

    Rows matching ``first`` bypass every filter.  Offered only for
    compatibility; :func:`apply_filter` is the default.
    """
    pred = as_filter(f).predicate()
    if pred is None:
        return sig.where(first | second)
    return sig.where(first | (second & pred))
