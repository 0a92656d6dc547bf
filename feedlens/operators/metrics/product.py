"""Product / app team tab metrics (M16-M19), over mobile stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions.predicates import is_mobile, mobile_parts
from feedlens.functions.text import topic_counts
from feedlens.operators.filters import (
    SignalFilter, apply_filter, apply_filter_reference_precedence,
)
from feedlens.schema import APP_ISSUE_TOPICS


def _mobile(sig: DataFrame, f, reference_precedence: bool) -> DataFrame:
    if reference_precedence:
        a, b = mobile_parts()
        return apply_filter_reference_precedence(sig, f, a, b)
    return apply_filter(sig, f, is_mobile())


def device_comparison(sig: DataFrame, f: SignalFilter | None = None,
                      reference_precedence: bool = False) -> DataFrame:
    """Mean rating (when the column exists) and mean sentiment per mobile source.

    ``reference_precedence=True`` reproduces the reference's unparenthesised
    splice, where App Store rows bypass every filter.
    """
    s = _mobile(sig, f, reference_precedence)
    aggs = []
    if "rating" in sig.columns:
        aggs.append(F.avg("rating").alias("avg_rating"))
    aggs.append(F.avg("sentiment_score").alias("avg_sentiment"))
    return s.groupBy("source").agg(*aggs)


def rating_distribution(sig: DataFrame, f: SignalFilter | None = None) -> DataFrame:
    """Mobile ratings rounded half away from zero to 1..5 stars, zero-filled.

    Rows rounding to 0 or above 5 disappear; when no mobile row with a
    positive rating passes, the result is empty (not five zeros).
    """
    s = apply_filter(sig, f, is_mobile() & F.col("rating").isNotNull() & (F.col("rating") > 0))
    counts = s.groupBy(star_bucket()).agg(F.count(F.lit(1)).alias("cantidad"))
    return finish_stars(counts)


def star_bucket():
    """Rating rounded half away from zero; outside 1..5 (0, 6+, overflow) -> bucket 0.

    The zero fill drops bucket 0, so there are at most six groups: a proven
    bound for the broadcast in :func:`finish_stars`.
    """
    rounded = F.round(F.col("rating"), 0).try_cast("int")
    return F.coalesce(F.when(rounded.between(1, 5), rounded), F.lit(0)).alias("estrellas")


def finish_stars(counts: DataFrame) -> DataFrame:
    """M17 from (estrellas bucket, cantidad); empty when ``counts`` is empty."""
    # max(struct) keeps the aggregate identical to the joined one, so the
    # subquery reuses its shuffle (a plain count would be pruned to a new plan)
    any_rows = counts.select(F.max(F.struct("cantidad", "estrellas")).isNotNull()).scalar()
    domain = counts.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("estrellas"))
    hits = F.broadcast(counts)
    return (domain.where(any_rows).join(hits, "estrellas", "left")
                  .select("estrellas",
                          F.coalesce(F.col("cantidad"), F.lit(0)).cast("bigint").alias("cantidad"),
                          F.concat(F.col("estrellas").cast("string"), F.lit(" ★"))
                          .alias("estrella_label"))
                  .orderBy("estrellas"))


def app_issue_topics(sig: DataFrame, f: SignalFilter | None = None) -> DataFrame:
    """Four app-issue keyword topics over ALL negative mobile texts."""
    s = apply_filter(sig, f, (F.col("sentiment_label") == "negative") & is_mobile())
    return (topic_counts(s, APP_ISSUE_TOPICS, label_col="Problema", count_col="Frecuencia")
            .orderBy(F.desc("Frecuencia"), F.asc("Problema")))


def yoy_volume_sentiment(sig: DataFrame, f: SignalFilter | None = None,
                         reference_precedence: bool = False) -> DataFrame:
    """Mobile volume and mean sentiment per year."""
    s = _mobile(sig, f, reference_precedence)
    return (s.groupBy("year").agg(F.count(F.lit(1)).alias("volumen"),
                                  F.avg("sentiment_score").alias("avg_sentiment"))
             .orderBy(F.asc_nulls_first("year")))
