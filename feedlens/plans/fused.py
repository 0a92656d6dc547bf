"""One-scan plans for the stakeholder bundles.

Each tab's metrics are different group-bys of the same filtered rows.
Instead of one scan per metric, a tab computes ONE ``GROUPING SETS``
aggregation (a single scan and a single shuffle; Spark's Expand feeds a
partial aggregate, so only small partial rows move).  Every per-row
predicate, including the keyword regexes, is evaluated once in a projection
below the Expand; the grouping sets only count booleans.  The aggregate is
small (one row per group of each set) and is what a bundle persists, never
the filtered base table.

``grouping_id()`` identifies the set of each row; the metric finishing steps
are the same functions the standalone metrics use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.dates import quarter_label
from feedlens.functions.predicates import is_churning, is_mobile, mobile_parts
from feedlens.functions.text import keyword_match
from feedlens.operators.filters import SignalFilter, as_filter
from feedlens.operators.metrics import direction as D
from feedlens.operators.metrics import marketing as MK
from feedlens.operators.metrics import product as P
from feedlens.operators.metrics import retention as R
from feedlens.schema import (
    APP_ISSUE_TOPICS, CHURN_ACTIONS, COMPLAINT_ACTIONS, COMPLAINT_OR_CHURN_ACTIONS,
    COMPLAINT_TOPICS, PRECHURN_ACTIONS, REGULATORY_SOURCE,
)


def _gid(keys: list[str], grouped: list[str]) -> int:
    """grouping_id() of a set: bit i (from the left) is 1 when keys[i] is NOT grouped."""
    n = len(keys)
    return sum(1 << (n - 1 - i) for i, k in enumerate(keys) if k not in grouped)


def _grouping_sets(rows: DataFrame, keys: list[str], sets: list[list[str]], aggs: list[Column]) -> DataFrame:
    return rows.groupingSets(sets, *keys).agg(*aggs, F.grouping_id().alias("gid"))


def _global_row(agg: DataFrame, gid: int, cols: list[str]) -> DataFrame:
    """The grand-total row; zeros when the input is empty (grouping sets emit no row then)."""
    one = agg.sparkSession.range(1).select(F.lit(gid).alias("gid"))
    # at most one row per gid: a proven broadcast bound
    row = F.broadcast(agg.where(F.col("gid") == gid).select("gid", *cols))
    joined = one.join(row, "gid", "left")
    return joined.select(*[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in cols])


def _count_if(c: Column, name: str) -> Column:
    return F.count_if(c).alias(name)


def _topic_flags(topics, cond: Column, prefix: str) -> list[Column]:
    return [(cond & keyword_match(F.col("lowered"), rx)).alias(f"{prefix}{i}") for i, (_, rx) in enumerate(topics)]


def _with_lowered(rows: DataFrame) -> DataFrame:
    """Adds the text in lower case, which all keyword flags share."""
    return rows.withColumn("lowered", F.lower(F.coalesce(F.col("text"), F.lit(""))))


def _stack_topics(row: DataFrame, topics, prefix: str, label: str) -> DataFrame:
    def q(s: str) -> str:
        return "'" + s.replace("'", "\\'") + "'"
    pairs = ", ".join(f"{q(name)}, {prefix}{i}" for i, (name, _) in enumerate(topics))
    return (row.selectExpr(f"stack({len(topics)}, {pairs}) AS ({label}, Frecuencia)")
               .orderBy(F.desc("Frecuencia"), F.asc(label)))


# ---------------------------------------------------------------------------
# B1 marketing: M1-M5
# ---------------------------------------------------------------------------

def marketing_aggregate(base: DataFrame) -> DataFrame:
    rows = base.select(
        "year", quarter_label().alias("quarter"), "month", "source", "sentiment_score",
        (F.col("sentiment_label") == "positive").alias("is_pos"),
        (F.col("sentiment_label") == "negative").alias("is_neg"),
        F.col("customer_action").isin(COMPLAINT_OR_CHURN_ACTIONS).alias("is_cc"))
    keys = ["year", "quarter", "month", "source"]
    sets = [[], ["year", "quarter"], ["source"], ["month"]]
    return _grouping_sets(rows, keys, sets, [
        F.count(F.lit(1)).alias("n"), _count_if(F.col("is_pos"), "pos"),
        _count_if(F.col("is_neg"), "neg"), _count_if(F.col("is_cc"), "cc"),
        F.sum("sentiment_score").alias("ssum"), F.count("sentiment_score").alias("scnt")])


def marketing_frames(agg: DataFrame) -> dict[str, DataFrame]:
    keys = ["year", "quarter", "month", "source"]
    g = lambda *grouped: F.col("gid") == _gid(keys, list(grouped))
    total = _global_row(agg, _gid(keys, []), ["n", "pos", "neg"])
    nps = MK.finish_nps(total.select(F.col("n").alias("total_signals"),
                                     F.col("pos").alias("promoters"),
                                     F.col("neg").alias("detractors")))
    by_source = agg.where(g("source"))
    return {
        "nps": nps,
        "nps_breakdown": MK.breakdown_from_nps(nps),
        "complaint_velocity": MK.finish_velocity(
            agg.where(g("year", "quarter") & (F.col("cc") > 0))
               .select("year", "quarter", F.col("cc").alias("quejas"))),
        "sentiment_by_channel": MK.finish_by_channel(
            by_source.where(F.col("scnt") > 0)
                     .select("source", (F.col("ssum") / F.col("scnt")).alias("avg_sentiment"))),
        "monthly_activity": MK.finish_monthly(
            agg.where(g("month")).select("month", F.col("n").alias("volumen"))),
        "source_impact": MK.finish_source_impact(by_source.select("source", "pos", "neg", "n")),
    }


# ---------------------------------------------------------------------------
# B2 direction: M6-M10
# ---------------------------------------------------------------------------

_DIR_KEYS = ["customer_action", "year", "company", "product_service"]


def direction_aggregate(base: DataFrame) -> DataFrame:
    rows = base.select(
        *_DIR_KEYS, "sentiment_score",
        (F.col("source") == REGULATORY_SOURCE).alias("is_reg"),
        F.col("customer_action").isin(PRECHURN_ACTIONS).alias("is_pre"))
    sets = [["customer_action"], [], ["year"], ["company"], ["company", "product_service"]]
    return _grouping_sets(rows, _DIR_KEYS, sets, [
        F.count(F.lit(1)).alias("n"), _count_if(F.col("is_reg"), "reg"),
        _count_if(F.col("is_pre"), "pre"),
        F.sum("sentiment_score").alias("ssum"), F.count("sentiment_score").alias("scnt")])


def direction_frames(agg: DataFrame, min_count: int = 500, limit: int = 15,
                     pair_limit: int = 500, product_limit: int = 8) -> dict[str, DataFrame]:
    g = lambda *grouped: F.col("gid") == _gid(_DIR_KEYS, list(grouped))
    avg = F.when(F.col("scnt") > 0, F.col("ssum") / F.col("scnt")).alias("avg_sentiment")
    total = _global_row(agg, _gid(_DIR_KEYS, []), ["n", "reg"])
    return {
        "churn_causes": D.finish_churn_causes(
            agg.where(g("customer_action") & F.col("customer_action").isin(CHURN_ACTIONS))
               .select("customer_action", F.col("n").alias("cantidad"))),
        "regulatory_exposure": D.finish_regulatory(
            total.select(F.col("reg").alias("regulatorias"), F.col("n").alias("total"))),
        "prechurn_trend": D.finish_prechurn(
            agg.where(g("year") & (F.col("pre") > 0)).select("year", F.col("pre").alias("prechurn"))),
        "competitive_benchmark": D.finish_benchmark(
            agg.where(g("company") & (F.col("scnt") > 0))
               .select("company", avg, F.col("scnt").alias("n")), min_count, limit),
        "company_product_heatmap": D.finish_heatmap(
            agg.where(g("company", "product_service")).select("company", "product_service", avg, "n"),
            pair_limit, product_limit),
    }


# ---------------------------------------------------------------------------
# B3 retention: M11-M15
# ---------------------------------------------------------------------------

_RET_KEYS = ["company", "product_service", "estado"]


def retention_aggregate(base: DataFrame) -> DataFrame:
    neg = F.col("sentiment_label") == "negative"
    rows = _with_lowered(base).select(
        "company", "product_service", R.state_name().alias("estado"), "date",
        (F.col("customer_action") == "complaining").alias("is_comp"),
        (F.col("customer_action") == "formal_complaint").alias("is_formal"),
        neg.alias("is_neg"), is_churning().alias("is_churn"),
        (F.col("customer_action").isin(COMPLAINT_ACTIONS) & F.col("country").isNotNull())
        .alias("is_state"),
        *_topic_flags(COMPLAINT_TOPICS, neg, "t"))
    sets = [[], ["company"], ["product_service"], ["estado"]]
    topics = [_count_if(F.col(f"t{i}"), f"t{i}") for i in range(len(COMPLAINT_TOPICS))]
    return _grouping_sets(rows, _RET_KEYS, sets, [
        F.count(F.lit(1)).alias("n"),
        _count_if(F.col("is_comp"), "complaining"), _count_if(F.col("is_formal"), "formal_complaint"),
        _count_if(F.col("is_neg"), "neg"), _count_if(F.col("is_churn"), "churn"),
        _count_if(F.col("is_state"), "state"),
        F.min(F.when(F.col("is_neg"), F.col("date"))).alias("date_neg"),
        F.max(F.when(F.col("is_churn"), F.col("date"))).alias("date_churn"),
        *topics])


def retention_frames(agg: DataFrame, product_limit: int = 10, state_limit: int = 20) -> dict[str, DataFrame]:
    g = lambda *grouped: F.col("gid") == _gid(_RET_KEYS, list(grouped))
    topic_cols = [f"t{i}" for i in range(len(COMPLAINT_TOPICS))]
    total = _global_row(agg, _gid(_RET_KEYS, []), ["complaining", "formal_complaint", *topic_cols])
    return {
        "escalation_rate": R.finish_escalation(total.select("complaining", "formal_complaint")),
        "behavior_cycle": R.finish_cycle(agg.where(g("company")).select("company", "date_neg", "date_churn")),
        "product_risk": R.finish_product_risk(
            agg.where(g("product_service"))
               .select(F.col("product_service").alias("product"), "neg", "churn", F.col("n").alias("vol")),
            product_limit),
        "complaint_topics": _stack_topics(total, COMPLAINT_TOPICS, "t", "Topic"),
        "state_intensity": R.finish_state(
            agg.where(g("estado") & (F.col("state") > 0) & F.col("estado").isNotNull())
               .select("estado", F.col("state").alias("quejas")), state_limit),
    }


# ---------------------------------------------------------------------------
# B4 product: M16-M19 (mobile rows)
# ---------------------------------------------------------------------------

_PROD_KEYS = ["source", "estrellas", "year"]


def product_aggregate(sig: DataFrame, f: SignalFilter | dict | None = None,
                      reference_precedence: bool = False) -> DataFrame:
    """Mobile rows; with ``reference_precedence`` M16/M19 see ``A OR (B AND filters)``
    while M17/M18 (parenthesised in the reference) see ``(A OR B) AND filters``."""
    if "rating" not in sig.columns:
        sig = sig.withColumn("rating", F.lit(None).cast("double"))
    pred = as_filter(f).predicate()
    strict = is_mobile() if pred is None else (is_mobile() & pred)
    if reference_precedence and pred is not None:
        a, b = mobile_parts()
        base = sig.where(a | (b & pred))
    else:
        base = sig.where(strict)
    neg = F.col("sentiment_label") == "negative"
    rows = _with_lowered(base).select(
        "source", P.star_bucket(), "year", "rating", "sentiment_score",
        (strict & F.col("rating").isNotNull() & (F.col("rating") > 0)).alias("is_star"),
        *_topic_flags(APP_ISSUE_TOPICS, strict & neg, "a"))
    sets = [["source"], ["estrellas"], [], ["year"]]
    topics = [_count_if(F.col(f"a{i}"), f"a{i}") for i in range(len(APP_ISSUE_TOPICS))]
    return _grouping_sets(rows, _PROD_KEYS, sets, [
        F.count(F.lit(1)).alias("n"), _count_if(F.col("is_star"), "stars_n"),
        F.sum("rating").alias("rsum"), F.count("rating").alias("rcnt"),
        F.sum("sentiment_score").alias("ssum"), F.count("sentiment_score").alias("scnt"),
        *topics])


def product_frames(agg: DataFrame, has_rating: bool = True) -> dict[str, DataFrame]:
    g = lambda *grouped: F.col("gid") == _gid(_PROD_KEYS, list(grouped))
    avg_s = F.when(F.col("scnt") > 0, F.col("ssum") / F.col("scnt")).alias("avg_sentiment")
    avg_r = F.when(F.col("rcnt") > 0, F.col("rsum") / F.col("rcnt")).alias("avg_rating")
    topic_cols = [f"a{i}" for i in range(len(APP_ISSUE_TOPICS))]
    total = _global_row(agg, _gid(_PROD_KEYS, []), topic_cols)
    device_cols = ["source", avg_r, avg_s] if has_rating else ["source", avg_s]
    return {
        "device_comparison": agg.where(g("source")).select(*device_cols),
        "rating_distribution": P.finish_stars(
            agg.where(g("estrellas") & (F.col("stars_n") > 0))
               .select("estrellas", F.col("stars_n").alias("cantidad"))),
        "app_issue_topics": _stack_topics(total, APP_ISSUE_TOPICS, "a", "Problema"),
        "yoy_volume_sentiment": agg.where(g("year"))
                                   .select("year", F.col("n").alias("volumen"), avg_s)
                                   .orderBy(F.asc_nulls_first("year")),
    }


__all__ = [
    "marketing_aggregate", "marketing_frames", "direction_aggregate", "direction_frames",
    "retention_aggregate", "retention_frames", "product_aggregate", "product_frames",
]
