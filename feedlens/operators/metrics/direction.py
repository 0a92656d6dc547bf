"""General-direction tab metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions.rounding import numpy_round, pct_round
from feedlens.operators.filters import SignalFilter, apply_filter
from feedlens.schema import CHURN_ACTIONS, CHURN_CAUSE_LABELS, PRECHURN_ACTIONS, REGULATORY_SOURCE


def churn_causes(sig: DataFrame, f: SignalFilter | None = None) -> DataFrame:
    """M6: counts of the three churn actions, cause label, share of the churn total.

    The filter on three action values bounds the result to three rows, so the
    whole-result total is a window over at most three rows.  ``pct`` is
    rounded like pandas (half-even on the double).
    """
    s = apply_filter(sig, f, F.col("customer_action").isin(CHURN_ACTIONS))
    counts = s.groupBy("customer_action").agg(F.count(F.lit(1)).alias("cantidad"))
    return finish_churn_causes(counts)


def finish_churn_causes(counts: DataFrame) -> DataFrame:
    """M6 from (customer_action, cantidad) restricted to the three churn actions."""
    labels = F.create_map(*[x for k, v in CHURN_CAUSE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    total = F.sum("cantidad").over(Window.partitionBy())
    return counts.select(
        "customer_action", "cantidad",
        F.coalesce(F.try_element_at(labels, F.col("customer_action")),
                   F.col("customer_action")).alias("causa_label"),
        numpy_round(F.col("cantidad") / total * 100.0).alias("pct"),
        total.cast("bigint").alias("total_churn"),
    )


def regulatory_exposure(sig: DataFrame, f: SignalFilter | None = None) -> DataFrame:
    """M7: rows from the regulatory channel, total rows, share (1 dp), one row."""
    s = apply_filter(sig, f)
    agg = s.agg(F.count_if(F.col("source") == REGULATORY_SOURCE).alias("regulatorias"),
                F.count(F.lit(1)).alias("total"))
    return finish_regulatory(agg)


def finish_regulatory(agg: DataFrame) -> DataFrame:
    return agg.select("total", "regulatorias",
                      pct_round(F.col("regulatorias"), F.col("total")).alias("pct"))


def prechurn_trend(sig: DataFrame, f: SignalFilter | None = None) -> DataFrame:
    """M8: early-warning actions per year."""
    s = apply_filter(sig, f, F.col("customer_action").isin(PRECHURN_ACTIONS))
    return finish_prechurn(s.groupBy("year").agg(F.count(F.lit(1)).alias("prechurn")))


def finish_prechurn(out: DataFrame) -> DataFrame:
    return out.orderBy(F.asc_nulls_first("year"))


def competitive_benchmark(sig: DataFrame, f: SignalFilter | None = None,
                          min_count: int = 500, limit: int = 15) -> DataFrame:
    """M9: lowest mean sentiment per company with more than ``min_count`` scored rows.

    Ties are broken by company so the ``limit`` cut is deterministic.
    """
    s = apply_filter(sig, f, F.col("sentiment_score").isNotNull())
    agg = (s.groupBy("company")
             .agg(F.avg("sentiment_score").alias("avg_sentiment"), F.count(F.lit(1)).alias("n")))
    return finish_benchmark(agg, min_count, limit)


def finish_benchmark(agg: DataFrame, min_count: int = 500, limit: int = 15) -> DataFrame:
    """M9 from (company, avg_sentiment, n = scored rows)."""
    return (agg.where(F.col("n") > min_count).orderBy(F.asc("avg_sentiment"), F.asc_nulls_first("company"))
               .limit(limit).select("company", "avg_sentiment"))


def company_product_heatmap(sig: DataFrame, f: SignalFilter | None = None,
                            pair_limit: int = 500, product_limit: int = 8) -> DataFrame:
    """Mean sentiment per (company, product) for the busiest pairs.

    Keeps the ``pair_limit`` pairs with most rows (ties by company, product),
    then only the ``product_limit`` products with most non-null cells among
    them (NULL product never ranks).  Both cuts run on bounded inputs
    (``TakeOrderedAndProject``); the semi join back is on <= pair_limit rows.
    """
    s = apply_filter(sig, f)
    pairs = (s.groupBy("company", "product_service")
               .agg(F.avg("sentiment_score").alias("avg_sentiment"), F.count(F.lit(1)).alias("n")))
    return finish_heatmap(pairs, pair_limit, product_limit)


def finish_heatmap(pairs: DataFrame, pair_limit: int = 500, product_limit: int = 8) -> DataFrame:
    """M10 from (company, product_service, avg_sentiment, n = rows)."""
    top = (pairs.orderBy(F.desc("n"), F.asc_nulls_first("company"),
                         F.asc_nulls_first("product_service"))
                .limit(pair_limit))
    products = (top.where(F.col("product_service").isNotNull())
                   .groupBy("product_service").agg(F.count("avg_sentiment").alias("cells"))
                   .orderBy(F.desc("cells"), F.asc("product_service"))
                   .limit(product_limit).select("product_service"))
    return (top.join(F.broadcast(products), "product_service", "left_semi")
               .select("company", "product_service", "avg_sentiment"))
