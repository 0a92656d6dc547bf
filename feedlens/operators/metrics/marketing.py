"""Marketing tab metrics (M1-M5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions.dates import month_label, quarter_label
from feedlens.functions.rounding import pct_round, ratio_units
from feedlens.operators.filters import SignalFilter, apply_filter
from feedlens.schema import COMPLAINT_OR_CHURN_ACTIONS


def nps_proxy(sig: DataFrame, f: SignalFilter | None = None) -> DataFrame:
    """M1: NPS proxy from sentiment labels, one row.

    promoters = label 'positive', detractors = 'negative', passives = the
    rest (NULL and unknown labels included).  Percentages are rounded to one
    decimal and the score is the difference of the ROUNDED percentages.
    All zero when no row passes the filter.
    """
    s = apply_filter(sig, f)
    agg = s.agg(
        F.count(F.lit(1)).alias("total_signals"),
        F.count_if(F.col("sentiment_label") == "positive").alias("promoters"),
        F.count_if(F.col("sentiment_label") == "negative").alias("detractors"),
    )
    return finish_nps(agg)


def finish_nps(agg: DataFrame) -> DataFrame:
    """M1 from one row of (total_signals, promoters, detractors)."""
    units_p = F.coalesce(ratio_units(F.col("promoters") * 100, F.col("total_signals")), F.lit(0))
    units_d = F.coalesce(ratio_units(F.col("detractors") * 100, F.col("total_signals")), F.lit(0))
    return agg.select(
        "total_signals", "promoters",
        F.greatest(F.col("total_signals") - F.col("promoters") - F.col("detractors"),
                   F.lit(0)).cast("bigint").alias("passives"),
        "detractors",
        (units_p.cast("double") / 10.0).alias("pct_promoters"),
        (units_d.cast("double") / 10.0).alias("pct_detractors"),
        ((units_p - units_d).cast("double") / 10.0).alias("nps_score"),
    )


def nps_breakdown(sig: DataFrame, f: SignalFilter | None = None) -> DataFrame:
    """M1 breakdown + V6: three segments with count and share (1 dp)."""
    return breakdown_from_nps(nps_proxy(sig, f))


def breakdown_from_nps(kpi: DataFrame) -> DataFrame:
    long = kpi.selectExpr(
        "total_signals",
        "stack(3, 'Promotores', promoters, 'Pasivos', passives, "
        "'Detractores', detractors) AS (Segmento, Cantidad)")
    return long.select(
        "Segmento", "Cantidad",
        pct_round(F.col("Cantidad"), F.col("total_signals")).alias("share_pct"))


def complaint_velocity(sig: DataFrame, f: SignalFilter | None = None) -> DataFrame:
    """M2: complaint + churn actions by (year, quarter); NULL month falls in Q4."""
    s = apply_filter(sig, f, F.col("customer_action").isin(COMPLAINT_OR_CHURN_ACTIONS))
    out = (s.groupBy("year", quarter_label().alias("quarter"))
             .agg(F.count(F.lit(1)).alias("quejas")))
    return finish_velocity(out)


def finish_velocity(out: DataFrame) -> DataFrame:
    return (out.withColumn("periodo", F.concat(F.col("year").cast("string"), F.lit(" "),
                                               F.col("quarter")))
               .orderBy("year", "quarter"))


def sentiment_by_channel(sig: DataFrame, f: SignalFilter | None = None) -> DataFrame:
    """M3: mean sentiment score per source over non-null scores, descending."""
    s = apply_filter(sig, f, F.col("sentiment_score").isNotNull())
    return finish_by_channel(s.groupBy("source").agg(F.avg("sentiment_score").alias("avg_sentiment")))


def finish_by_channel(out: DataFrame) -> DataFrame:
    return out.orderBy(F.desc("avg_sentiment"), F.asc("source"))


def monthly_activity(sig: DataFrame, f: SignalFilter | None = None) -> DataFrame:
    """M4: signal count per month with its Spanish label (NULL out of 1..12)."""
    s = apply_filter(sig, f)
    return finish_monthly(s.groupBy("month").agg(F.count(F.lit(1)).alias("volumen")))


def finish_monthly(out: DataFrame) -> DataFrame:
    return out.withColumn("mes_label", month_label()).orderBy(F.asc_nulls_first("month"))


def source_impact(sig: DataFrame, f: SignalFilter | None = None) -> DataFrame:
    """M5: percentage of positive and negative labels per source (unrounded)."""
    s = apply_filter(sig, f)
    out = s.groupBy("source").agg(
        F.count_if(F.col("sentiment_label") == "positive").alias("pos"),
        F.count_if(F.col("sentiment_label") == "negative").alias("neg"),
        F.count(F.lit(1)).alias("n"))
    return finish_source_impact(out)


def finish_source_impact(out: DataFrame) -> DataFrame:
    """M5 from (source, pos, neg, n)."""
    return out.select(
        "source",
        (F.col("pos").cast("double") * 100.0 / F.col("n")).alias("pct_positive"),
        (F.col("neg").cast("double") * 100.0 / F.col("n")).alias("pct_negative"),
    )
