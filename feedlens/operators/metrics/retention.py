"""Retention and billing tab metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions.predicates import is_churning
from feedlens.functions.rounding import numpy_round, pct_round, ratio_round
from feedlens.functions.text import topic_counts
from feedlens.operators.filters import SignalFilter, apply_filter
from feedlens.schema import COMPLAINT_ACTIONS, COMPLAINT_TOPICS, US_PREFIXES


def escalation_rate(sig: DataFrame, f: SignalFilter | None = None) -> DataFrame:
    """Formal / (complaining + formal) x 100, 1 dp; 0.0 when neither occurs."""
    s = apply_filter(sig, f, F.col("customer_action").isin(COMPLAINT_ACTIONS))
    agg = s.agg(F.count_if(F.col("customer_action") == "complaining").alias("complaining"),
                F.count_if(F.col("customer_action") == "formal_complaint").alias("formal_complaint"))
    return finish_escalation(agg)


def finish_escalation(agg: DataFrame) -> DataFrame:
    return agg.select(
        "complaining", "formal_complaint",
        pct_round(F.col("formal_complaint"),
                  F.col("complaining") + F.col("formal_complaint")).alias("escalation_rate"))


def behavior_cycle(sig: DataFrame, f: SignalFilter | None = None) -> DataFrame:
    """Mean days from a company's first negative signal to its last churn.

    Per company (filters applied before grouping): first date with label
    'negative', last date with action LIKE 'churning%' (ASCII case-insensitive).
    Averaged over companies where both exist and churn is strictly later;
    1 dp, 0.0 when no company qualifies.  Two aggregations: by company, then
    global (one row).
    """
    s = apply_filter(sig, f)
    per_company = s.groupBy("company").agg(
        F.min(F.when(F.col("sentiment_label") == "negative", F.col("date"))).alias("date_neg"),
        F.max(F.when(is_churning(), F.col("date"))).alias("date_churn"),
    )
    return finish_cycle(per_company)


def finish_cycle(per_company: DataFrame) -> DataFrame:
    """M12 from (company, date_neg, date_churn)."""
    spans = per_company.where(
        F.col("date_neg").isNotNull() & F.col("date_churn").isNotNull()
        & (F.col("date_churn") > F.col("date_neg")))
    agg = spans.agg(F.sum(F.datediff("date_churn", "date_neg")).alias("total_days"),
                    F.count(F.lit(1)).alias("companies"))
    return agg.select(
        "companies",
        ratio_round(F.coalesce(F.col("total_days"), F.lit(0)), F.col("companies")).alias("avg_days"))


def product_risk(sig: DataFrame, f: SignalFilter | None = None, limit: int = 10) -> DataFrame:
    """Churn-risk score per product, top ``limit``.

    score = 40 neg_ratio + 40 churn_ratio + 20 vol / max(vol), 1 dp, clipped to
    0..100, rounded like pandas (half-even on the double).  max(vol) is an
    uncorrelated scalar subquery over the per-product aggregate (one value),
    not a single-partition window.
    """
    s = apply_filter(sig, f)
    per_product = s.groupBy(F.col("product_service").alias("product")).agg(
        F.count_if(F.col("sentiment_label") == "negative").alias("neg"),
        F.count_if(is_churning()).alias("churn"),
        F.count(F.lit(1)).alias("vol"),
    )
    return finish_product_risk(per_product, limit)


def finish_product_risk(per_product: DataFrame, limit: int = 10) -> DataFrame:
    """M13 from (product, neg, churn, vol)."""
    # max over a struct led by vol keeps every aggregate of per_product alive,
    # so the subquery's plan equals the main one and AQE reuses its shuffle
    max_vol = per_product.select(F.max(F.struct("vol", "neg", "churn")).getField("vol")).scalar()
    neg_ratio = F.col("neg").cast("double") * 1.0 / F.col("vol")
    churn_ratio = F.col("churn").cast("double") * 1.0 / F.col("vol")
    norm_vol = F.col("vol") / max_vol
    raw = neg_ratio * 40 + churn_ratio * 40 + norm_vol * 20
    score = F.least(F.greatest(numpy_round(raw, 1), F.lit(0.0)), F.lit(100.0))
    return (per_product.select("product", score.alias("score"))
                       .orderBy(F.desc("score"), F.asc_nulls_first("product"))
                       .limit(limit))


def complaint_topics(sig: DataFrame, f: SignalFilter | None = None) -> DataFrame:
    """Six keyword topics over ALL negative texts (multi-label), descending.

    The reference samples at most 20,000 rows; here every matching row counts.
    """
    s = apply_filter(sig, f, F.col("sentiment_label") == "negative")
    return (topic_counts(s, COMPLAINT_TOPICS, label_col="Topic", count_col="Frecuencia")
            .orderBy(F.desc("Frecuencia"), F.asc("Topic")))


def finish_state(out: DataFrame, limit: int = 20) -> DataFrame:
    """M15 from (estado, quejas)."""
    return out.orderBy(F.desc("quejas"), F.asc("estado")).limit(limit)


def state_name(country: str = "country"):
    out = F.col(country)
    for p in US_PREFIXES:
        out = F.replace(out, F.lit(p), F.lit(""))
    return out


def state_intensity(sig: DataFrame, f: SignalFilter | None = None, limit: int = 20) -> DataFrame:
    """Complaints per state (US prefixes removed), top ``limit``."""
    s = apply_filter(sig, f, F.col("customer_action").isin(COMPLAINT_ACTIONS)
                     & F.col("country").isNotNull())
    return finish_state(s.groupBy(state_name().alias("estado"))
                        .agg(F.count(F.lit(1)).alias("quejas")), limit)
