"""Derived columns and small operators the dashboards compute at render time (V1-V9).

Each takes a metric result (a small DataFrame) and returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.rounding import numpy_round


def satisfaction_band(score_col: str = "sat_score"):
    s = F.col(score_col)
    return F.when(s < 40, "danger").when(s < 55, "warning").otherwise("success")


def benchmark_satisfaction(bench: DataFrame) -> DataFrame:
    """V1 + V2: satisfaction ``(avg + 1) / 2 * 100`` (1 dp, pandas rounding) and its band."""
    sat = numpy_round((F.col("avg_sentiment") + 1) / 2 * 100, 1)
    return (bench.withColumn("sat_score", sat)
                 .withColumn("band", satisfaction_band())
                 .orderBy(F.desc("sat_score"), F.asc("company")))


def channel_bands(by_channel: DataFrame) -> DataFrame:
    """V3: sentiment band per channel: < 0 danger, < 0.1 warning, else success."""
    v = F.col("avg_sentiment")
    return by_channel.withColumn(
        "band", F.when(v < 0, "danger").when(v < 0.1, "warning").otherwise("success"))


def heatmap_cells(heat: DataFrame, company_limit: int = 8) -> DataFrame:
    """V4 (long form): satisfaction to 0 dp for the companies with most cells.

    NULL companies, NULL products and empty cells are dropped, as a pivot
    table does; company ties are broken by name.  Works on the <= 500 rows of
    the heatmap metric; the company ranking is a bounded top-k.
    """
    cells = (heat.where(F.col("company").isNotNull())
                 .select("company", "product_service",
                         numpy_round((F.col("avg_sentiment") + 1) / 2 * 100, 0).alias("sat_score")))
    top = (cells.groupBy("company").agg(F.count("sat_score").alias("cells"))
                .orderBy(F.desc("cells"), F.asc("company")).limit(company_limit)
                .select("company"))
    return (cells.join(F.broadcast(top), "company", "left_semi")
                 .where(F.col("product_service").isNotNull() & F.col("sat_score").isNotNull()))


def heatmap_matrix(cells: DataFrame, products: Sequence[str] | None = None) -> DataFrame:
    """V4 (wide form): company x product matrix of mean satisfaction.

    With ``products`` a column for each of them; without, one map column
    ``scores`` from product to score, so that no value has to be known, and
    nothing collected, before the plan runs.
    """
    if products is not None:
        return cells.groupBy("company").pivot("product_service", list(products)).agg(F.avg("sat_score"))
    means = cells.groupBy("company", "product_service").agg(F.avg("sat_score").alias("score"))
    return means.groupBy("company").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("product_service", "score")))).alias("scores"))


def device_scaled(device: DataFrame) -> DataFrame:
    """V5: sentiment on the 0..5 rating scale, ``(avg + 1) / 2 * 5``."""
    return device.withColumn("sentiment_5", (F.col("avg_sentiment") + 1) / 2 * 5)


def prechurn_total(trend: DataFrame) -> DataFrame:
    """V7: total of the pre-churn trend (0 when empty)."""
    return trend.agg(F.coalesce(F.sum("prechurn"), F.lit(0)).cast("bigint").alias("prechurn_total"))


# V8: when a result counts as empty.  "rows": no rows; "zero": its value (one row) is zero;
# "sum": the columns add up to zero or there are no rows; "fewer": fewer rows than needed.
EMPTY_RULES = {
    "nps": ("zero", "total_signals"),
    "complaint_velocity": ("sum", "quejas"),
    "sentiment_by_channel": ("rows",),
    "monthly_activity": ("sum", "volumen"),
    "source_impact": ("sum", "pct_positive", "pct_negative"),
    "churn_causes": ("rows",),
    "regulatory_exposure": ("zero", "total"),
    "prechurn_trend": ("rows",),
    "competitive_benchmark": ("rows",),
    "company_product_heatmap": ("rows",),
    "escalation_rate": ("zero", "escalation_rate"),
    "behavior_cycle": ("zero", "avg_days"),
    "product_risk": ("fewer", 3),
    "complaint_topics": ("sum", "Frecuencia"),
    "state_intensity": ("sum", "quejas"),
    "device_comparison": ("rows",),
    "rating_distribution": ("sum", "cantidad"),
    "app_issue_topics": ("sum", "Frecuencia"),
    "yoy_volume_sentiment": ("rows",),
}


def is_empty(rule: tuple) -> Column:
    """The aggregate that tells whether a result is empty by a rule of :data:`EMPTY_RULES`."""
    kind, *args = rule
    if kind == "rows":
        return F.count(F.lit(1)) == 0
    if kind == "fewer":
        return F.count(F.lit(1)) < args[0]
    total = sum((F.coalesce(F.sum(c), F.lit(0)) for c in args[1:]), F.coalesce(F.sum(args[0]), F.lit(0)))
    return total == 0


def status(df: DataFrame, title: str, rule: tuple = ("rows",)) -> DataFrame:
    """V8: one row: title, is_empty, title with the no-data suffix when empty."""
    agg = df.agg(is_empty(rule).alias("is_empty"))
    return agg.select(
        F.lit(title).alias("title"), "is_empty",
        F.when(F.col("is_empty"), F.lit(f"{title} (Sin datos para la selección)"))
        .otherwise(F.lit(title)).alias("display_title"))


def status_table(tables: dict[str, DataFrame]) -> DataFrame:
    """V8 for a bundle: a row for each of its results that has an emptiness rule."""
    rows = [status(df, name, EMPTY_RULES[name]) for name, df in tables.items() if name in EMPTY_RULES]
    return reduce(DataFrame.unionByName, rows)


def nps_band(nps: DataFrame) -> DataFrame:
    """V9: NPS sign band (>= 0 success, else danger; 'empty' without rows)."""
    return nps.withColumn(
        "band", F.when(F.col("total_signals") == 0, "empty")
                 .when(F.col("nps_score") >= 0, "success").otherwise("danger"))


def regulatory_band(reg: DataFrame) -> DataFrame:
    """V9: regulatory band (> 50 danger, else warning; 'empty' without rows)."""
    return reg.withColumn(
        "band", F.when(F.col("total") == 0, "empty")
                 .when(F.col("pct") > 50, "danger").otherwise("warning"))
