"""Leave-one-out filter options (O1-O6) in ONE scan.

The options of dimension X are the values of X among rows passing every
active filter except X's own.  Instead of five queries, each row is tested
once per filter group, ``stack`` emits (dimension, value) for every
dimension whose leave-one-out predicate the row passes, and one
``groupBy(dim, value).count()`` (partial aggregation on the map side) counts
them all.  Thresholds and caps then run on the small aggregate; the capped
dimensions use ``orderBy().limit()`` (bounded top-k), never a window over a
whole dimension.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.operators.filters import SignalFilter, as_filter
from feedlens.schema import (
    FACET_CAP, FACET_LABEL_WIDTH, FACET_MIN_COUNT, TAB_CONFIG, VALID_ACTIONS,
)

# dimension -> (signal column, filter keys that are its own)
DIMENSIONS = {
    "year": ("year", ("period", "years", "months")),
    "source": ("source", ("sources",)),
    "company": ("company", ("companies",)),
    "product": ("product_service", ("products",)),
    "action": ("customer_action", ("actions",)),
}
DIM_ORDER = {d: i for i, d in enumerate(DIMENSIONS)}


def _all_but(conds: dict[str, Column], own: tuple[str, ...]) -> Column:
    rest = [c for k, c in conds.items() if k not in own]
    return reduce(lambda a, b: a & b, rest) if rest else F.lit(True)


def facet_counts(sig: DataFrame, f: SignalFilter | dict | None = None,
                 dimensions: Iterable[str] = tuple(DIMENSIONS)) -> DataFrame:
    """(dim, value, cnt) for the wanted dimensions, leave-one-out, one scan."""
    conds = as_filter(f).conditions()
    wanted = {d: DIMENSIONS[d] for d in dimensions}
    keeps = {d: _all_but(conds, own) for d, (_, own) in wanted.items()}
    # a row can only count somewhere if it passes all but at most one group
    pre = reduce(lambda a, b: a | b, keeps.values())
    flagged = sig.where(pre).select(
        *[F.col(c).cast("string").alias(f"v_{d}") for d, (c, _) in wanted.items()],
        *[k.alias(f"k_{d}") for d, k in keeps.items()],
    )
    pairs = ", ".join(f"'{d}', v_{d}, k_{d}" for d in wanted)
    long = flagged.selectExpr(f"stack({len(wanted)}, {pairs}) AS (dim, value, keep)")
    return (long.where(F.col("keep") & F.col("value").isNotNull())
                .groupBy("dim", "value").agg(F.count(F.lit(1)).alias("cnt")))


def _label(dim: str) -> Column:
    v, n = F.col("value"), F.format_number(F.col("cnt"), 0)
    if dim == "year":
        return v
    if dim in FACET_LABEL_WIDTH:
        w = FACET_LABEL_WIDTH[dim]
        v = F.concat(F.substring(v, 1, w), F.when(F.length(v) > w, F.lit("…")).otherwise(F.lit("")))
    return F.concat(v, F.lit(" ("), n, F.lit(")"))


def facet_options(sig: DataFrame, f: SignalFilter | dict | None = None, tab: str | None = None,
                  min_count: dict | None = None, cap: dict | None = None,
                  dimensions: Iterable[str] = tuple(DIMENSIONS)) -> DataFrame:
    """O1-O5 (+ the tab's source allow-list, F12): dim, value, cnt, label, for the wanted dimensions.

    Rows are sorted by dimension, then year ascending / count descending
    (value as tie-break).  ``min_count`` and ``cap`` override the defaults.
    """
    return options(facet_counts(sig, f, dimensions), tab, min_count, cap, dimensions)


def options(counts: DataFrame, tab: str | None = None, min_count: dict | None = None, cap: dict | None = None,
            dimensions: Iterable[str] = tuple(DIMENSIONS)) -> DataFrame:
    """The options of counted values (dim, value, cnt); see :func:`facet_options`."""
    mins = {**FACET_MIN_COUNT, **(min_count or {})}
    caps = {**FACET_CAP, **(cap or {})}
    parts = []
    for dim in dimensions:
        # One predicate over (dim, value, cnt): a filter on the grouping columns
        # alone would be pushed below the aggregate, giving five different plans
        # and five scans; this way all branches share one aggregate and its
        # shuffle is reused.
        ok = F.col("dim") == dim
        if dim == "action":
            ok = ok & F.col("value").isin(VALID_ACTIONS)
        if dim == "source" and tab is not None and TAB_CONFIG.get(tab, {}).get("sources"):
            ok = ok & F.col("value").isin(TAB_CONFIG[tab]["sources"])
        part = counts.where(F.when(ok, F.col("cnt")).otherwise(F.lit(-1)) >= mins[dim])
        if dim in caps:
            part = part.orderBy(F.desc("cnt"), F.asc("value")).limit(caps[dim])
        parts.append(part.withColumn("label", _label(dim)))
    out = reduce(DataFrame.unionByName, parts)
    dim_rank = F.create_map(*[x for d, i in DIM_ORDER.items() for x in (F.lit(d), F.lit(i))])
    year_key = F.when(F.col("dim") == "year", F.col("value").cast("int"))
    cnt_key = F.when(F.col("dim") != "year", F.col("cnt"))
    return out.orderBy(dim_rank[F.col("dim")], year_key.asc(), cnt_key.desc(), F.col("value"))


def year_bounds(options: DataFrame, year_from: int | None, year_to: int | None) -> DataFrame:
    """Year options with the disabled flags of the from/to pickers."""
    y = F.col("value").cast("int")
    return (options.where(F.col("dim") == "year")
                   .select(y.alias("year"), "label",
                           (y > F.lit(year_to) if year_to is not None else F.lit(False))
                           .alias("from_disabled"),
                           (y < F.lit(year_from) if year_from is not None else F.lit(False))
                           .alias("to_disabled"))
                   .orderBy("year"))
