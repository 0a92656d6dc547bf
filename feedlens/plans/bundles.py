"""Stakeholder bundles (B1-B4): the tables behind each dashboard tab.

By default a bundle runs its tab as ONE grouping-sets aggregation over the
filtered rows (:mod:`feedlens.plans.fused`): one scan and one shuffle for
the whole tab, and only that small aggregate is kept, in the checkpoint folder,
where lost executors cost nothing.  ``fused=False`` runs each metric on its own
over the filtered, column-pruned base instead (optionally persisted).  Both
return the same tables.  Use a bundle as a context manager so a persisted base
is released.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from feedlens.operators import derived as V
from feedlens.operators import metrics as M
from feedlens.operators.filters import SignalFilter, as_filter
from feedlens.plans import fused as FU
from feedlens.session import checkpoint_dir

# Columns each tab reads (column pruning before a persist of the base).
_COLUMNS = {
    "marketing": ["year", "month", "customer_action", "sentiment_score", "sentiment_label",
                  "source", "product_service", "company"],
    "direction": ["year", "month", "customer_action", "sentiment_score", "sentiment_label",
                  "source", "company", "product_service"],
    "retention": ["date", "year", "month", "customer_action", "sentiment_label", "source",
                  "company", "product_service", "text", "country"],
}


class Bundle(dict):
    def __init__(self, frames: dict[str, DataFrame], held: DataFrame | None):
        super().__init__(frames)
        self._held = held

    def collect(self, max_workers: int = 8) -> dict[str, list]:
        """Run every table of the bundle at once and return their rows.

        The tables are independent small jobs (aggregates and top-k cuts of
        one persisted aggregate), so they are submitted concurrently from
        driver threads and Spark schedules them side by side.  Results are
        top-k cuts or one row per group; per-source tables have a row for each
        distinct source name.
        """
        from concurrent.futures import ThreadPoolExecutor

        if self._held is not None:
            self._held.count()  # materialise the shared aggregate once
        with ThreadPoolExecutor(max_workers=max_workers) as pool:
            futures = {k: pool.submit(df.collect) for k, df in self.items()}
            return {k: f.result() for k, f in futures.items()}

    def close(self) -> None:
        if self._held is not None:
            self._held.unpersist()
            self._held = None

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self.close()


def _hold(df: DataFrame, persist: bool) -> tuple[DataFrame, DataFrame | None]:
    if persist:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        return df, df
    return df, None


def _hold_small(df: DataFrame, persist: bool) -> tuple[DataFrame, DataFrame | None]:
    """A tab's aggregate, kept in the checkpoint folder by the first table that needs it.

    It is no cached plan: tables that combine several results of a tab (the
    status table) do not find a cached plan in all of them, and would scan the
    signals again for each.
    """
    if not persist:
        return df, None
    checkpoint_dir(df.sparkSession)
    df = df.checkpoint(eager=False)
    return df, df


def _base(sig: DataFrame, f: SignalFilter, tab: str) -> DataFrame:
    return f.apply(sig).select(*[c for c in _COLUMNS[tab] if c in sig.columns])


def marketing(sig: DataFrame, f: SignalFilter | dict | None = None, persist: bool = True,
              fused: bool = True) -> Bundle:
    """B1: M1-M5 + V3, V6, V9."""
    f = as_filter(f)
    if fused:
        agg, held = _hold_small(FU.marketing_aggregate(f.apply(sig)), persist)
        fr = FU.marketing_frames(agg)
    else:
        base, held = _hold(_base(sig, f, "marketing"), persist)
        fr = {"nps": M.nps_proxy(base), "nps_breakdown": M.nps_breakdown(base),
              "complaint_velocity": M.complaint_velocity(base),
              "sentiment_by_channel": M.sentiment_by_channel(base),
              "monthly_activity": M.monthly_activity(base), "source_impact": M.source_impact(base)}
    fr["nps"] = V.nps_band(fr["nps"])
    fr["sentiment_by_channel"] = V.channel_bands(fr["sentiment_by_channel"])
    fr["status"] = V.status_table(fr)
    return Bundle(fr, held)


def direction(sig: DataFrame, f: SignalFilter | dict | None = None, persist: bool = True,
              fused: bool = True, heatmap_products: Sequence[str] | None = None) -> Bundle:
    """B2: M6-M10 + V1, V2, V4, V7, V9.  ``heatmap_products``: see :func:`~feedlens.operators.derived.heatmap_matrix`."""
    f = as_filter(f)
    if fused:
        agg, held = _hold_small(FU.direction_aggregate(f.apply(sig)), persist)
        fr = FU.direction_frames(agg)
    else:
        base, held = _hold(_base(sig, f, "direction"), persist)
        fr = {"churn_causes": M.churn_causes(base), "regulatory_exposure": M.regulatory_exposure(base),
              "prechurn_trend": M.prechurn_trend(base),
              "competitive_benchmark": M.competitive_benchmark(base),
              "company_product_heatmap": M.company_product_heatmap(base)}
    fr["regulatory_exposure"] = V.regulatory_band(fr["regulatory_exposure"])
    fr["prechurn_total"] = V.prechurn_total(fr["prechurn_trend"])
    fr["benchmark_satisfaction"] = V.benchmark_satisfaction(fr["competitive_benchmark"])
    fr["heatmap_cells"] = V.heatmap_cells(fr["company_product_heatmap"])
    fr["heatmap_matrix"] = V.heatmap_matrix(fr["heatmap_cells"], heatmap_products)
    fr["status"] = V.status_table(fr)
    return Bundle(fr, held)


def retention(sig: DataFrame, f: SignalFilter | dict | None = None, persist: bool = True,
              fused: bool = True) -> Bundle:
    """M11-M15."""
    f = as_filter(f)
    if fused:
        agg, held = _hold_small(FU.retention_aggregate(f.apply(sig)), persist)
        fr = FU.retention_frames(agg)
    else:
        base, held = _hold(_base(sig, f, "retention"), persist)
        fr = {"escalation_rate": M.escalation_rate(base), "behavior_cycle": M.behavior_cycle(base),
              "product_risk": M.product_risk(base), "complaint_topics": M.complaint_topics(base),
              "state_intensity": M.state_intensity(base)}
    fr["status"] = V.status_table(fr)
    return Bundle(fr, held)


def product(sig: DataFrame, f: SignalFilter | dict | None = None, persist: bool = True,
            fused: bool = True, reference_precedence: bool = False) -> Bundle:
    """M16-M19 + V5, always without the source filter."""
    f = as_filter(f).without("sources")
    if fused:
        agg, held = _hold_small(FU.product_aggregate(sig, f, reference_precedence), persist)
        fr = FU.product_frames(agg, has_rating="rating" in sig.columns)
    else:
        held = None
        fr = {"device_comparison": M.device_comparison(sig, f, reference_precedence=reference_precedence),
              "rating_distribution": M.rating_distribution(sig, f),
              "app_issue_topics": M.app_issue_topics(sig, f),
              "yoy_volume_sentiment": M.yoy_volume_sentiment(sig, f,
                                                             reference_precedence=reference_precedence)}
    fr["device_scaled"] = V.device_scaled(fr["device_comparison"])
    fr["status"] = V.status_table(fr)
    return Bundle(fr, held)


BUNDLES = {"marketing": marketing, "direction": direction, "retention": retention, "product": product}
