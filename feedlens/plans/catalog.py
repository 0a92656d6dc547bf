"""Registered queries and their oracle SQL.

Each query takes ``(spark, sf_dir)``, derives the signal table from the
driver's tables (:mod:`feedlens.plans.testbed`) and runs one operator over
all of it.  The oracle is DuckDB SQL over the same tables with the same
derived ``signals`` CTE.  Column names match one to one.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from feedlens.functions.rounding import (
    numpy_round_sql, pct_round_sql, ratio_round_sql, ratio_units_sql,
)
from feedlens.operators import metrics as M
from feedlens.operators.filters import SignalFilter
from feedlens.plans.testbed import signals_from_tables, with_signals
from feedlens.schema import (
    APP_ISSUE_TOPICS, CHURN_ACTIONS, CHURN_CAUSE_LABELS, COMPLAINT_ACTIONS,
    COMPLAINT_OR_CHURN_ACTIONS, COMPLAINT_TOPICS, MONTH_LABELS, PRECHURN_ACTIONS,
)

Query = Callable[[SparkSession, str], DataFrame]

# Filters exercised by the *_filtered queries.
FILTER_A = SignalFilter(period=(1994, 1997),
                        sources=("Reddit", "Trustpilot", "CFPB", "AppStore", "GooglePlay"))
FILTER_B = SignalFilter(years=(1995, 1996, 1998), months=(1, 2, 3, 10, 11, 12),
                        products=("STANDARD", "PROMO", "LARGE"), sentiment="Negative")
FILTER_C = SignalFilter(period=(1999, 1999), sources=("GooglePlay",))

SQL_FILTER_A = ("year BETWEEN 1994 AND 1997 AND source IN "
                "('Reddit', 'Trustpilot', 'CFPB', 'AppStore', 'GooglePlay')")
SQL_FILTER_B = ("year IN (1995, 1996, 1998) AND month IN (1, 2, 3, 10, 11, 12) AND "
                "product_service IN ('STANDARD', 'PROMO', 'LARGE') AND sentiment_label = 'negative'")
SQL_FILTER_C = "year BETWEEN 1999 AND 1999 AND source IN ('GooglePlay')"

MOBILE_SQL = "(lower(source) LIKE '%appstore%' OR lower(source) LIKE '%google%play%')"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _metric(fn, f: SignalFilter | None = None, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(signals_from_tables(spark, sf_dir), f, **kw)
    run.__name__ = fn.__name__
    return run


def _where(*conds: str) -> str:
    conds = [c for c in conds if c]
    return ("WHERE " + " AND ".join(f"({c})" for c in conds)) if conds else ""


# ---------------------------------------------------------------------------
# Oracle SQL builders (one per metric, parameterised by the filter SQL)
# ---------------------------------------------------------------------------

def sql_nps_proxy(flt: str = "") -> str:
    up = ratio_units_sql("promoters * 100", "total_signals")
    ud = ratio_units_sql("detractors * 100", "total_signals")
    return with_signals(f"""
        SELECT total_signals, promoters,
               CAST(GREATEST(total_signals - promoters - detractors, 0) AS BIGINT) AS passives,
               detractors,
               CAST(COALESCE(up, 0) AS DOUBLE) / 10.0 AS pct_promoters,
               CAST(COALESCE(ud, 0) AS DOUBLE) / 10.0 AS pct_detractors,
               CAST(COALESCE(up, 0) - COALESCE(ud, 0) AS DOUBLE) / 10.0 AS nps_score
        FROM (SELECT *, {up} AS up, {ud} AS ud FROM (
            SELECT COUNT(*) AS total_signals,
                   COUNT(*) FILTER (WHERE sentiment_label = 'positive') AS promoters,
                   COUNT(*) FILTER (WHERE sentiment_label = 'negative') AS detractors
            FROM signals {_where(flt)}) a) b""")


def sql_nps_breakdown(flt: str = "") -> str:
    inner = sql_nps_proxy(flt)
    body = inner[inner.index("SELECT total_signals, promoters"):]
    cte = inner[:inner.index("SELECT total_signals, promoters")].rstrip()
    return f"""{cte}, kpi AS ({body}),
        seg AS (SELECT 'Promotores' AS Segmento, promoters AS Cantidad, total_signals FROM kpi
                UNION ALL SELECT 'Pasivos', passives, total_signals FROM kpi
                UNION ALL SELECT 'Detractores', detractors, total_signals FROM kpi)
        SELECT Segmento, Cantidad, {pct_round_sql('Cantidad', 'total_signals')} AS share_pct FROM seg"""


def sql_complaint_velocity(flt: str = "") -> str:
    return with_signals(f"""
        SELECT year, quarter, quejas, CAST(year AS VARCHAR) || ' ' || quarter AS periodo FROM (
          SELECT year,
                 CASE WHEN month BETWEEN 1 AND 3 THEN 'Q1' WHEN month BETWEEN 4 AND 6 THEN 'Q2'
                      WHEN month BETWEEN 7 AND 9 THEN 'Q3' ELSE 'Q4' END AS quarter,
                 COUNT(*) AS quejas
          FROM signals {_where(f"customer_action IN {_in(COMPLAINT_OR_CHURN_ACTIONS)}", flt)}
          GROUP BY 1, 2) t""")


def sql_sentiment_by_channel(flt: str = "") -> str:
    return with_signals(f"""
        SELECT source, AVG(sentiment_score) AS avg_sentiment FROM signals
        {_where("sentiment_score IS NOT NULL", flt)} GROUP BY source""")


def sql_monthly_activity(flt: str = "") -> str:
    labels = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MONTH_LABELS, start=1))
    return with_signals(f"""
        SELECT month, COUNT(*) AS volumen, CASE month {labels} END AS mes_label
        FROM signals {_where(flt)} GROUP BY month""")


def sql_source_impact(flt: str = "") -> str:
    return with_signals(f"""
        SELECT source,
          CAST(COUNT(*) FILTER (WHERE sentiment_label = 'positive') AS DOUBLE) * 100.0 / COUNT(*) AS pct_positive,
          CAST(COUNT(*) FILTER (WHERE sentiment_label = 'negative') AS DOUBLE) * 100.0 / COUNT(*) AS pct_negative
        FROM signals {_where(flt)} GROUP BY source""")


def sql_churn_causes(flt: str = "") -> str:
    labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CHURN_CAUSE_LABELS.items())
    return with_signals(f"""
        , c AS (SELECT customer_action, COUNT(*) AS cantidad FROM signals
                {_where(f"customer_action IN {_in(CHURN_ACTIONS)}", flt)} GROUP BY customer_action),
        t AS (SELECT CAST(SUM(cantidad) AS BIGINT) AS total_churn FROM c)
        SELECT customer_action, cantidad,
               COALESCE(CASE customer_action {labels} END, customer_action) AS causa_label,
               {numpy_round_sql('CAST(cantidad AS DOUBLE) / total_churn * 100.0')} AS pct, total_churn
        FROM c, t""".replace("\n        , c AS", "WITH c AS", 1))


def sql_regulatory_exposure(flt: str = "") -> str:
    return with_signals(f"""
        SELECT total, regulatorias, {pct_round_sql('regulatorias', 'total')} AS pct FROM (
          SELECT COUNT(*) FILTER (WHERE source = 'CFPB') AS regulatorias, COUNT(*) AS total
          FROM signals {_where(flt)}) a""")


def sql_prechurn_trend(flt: str = "") -> str:
    return with_signals(f"""
        SELECT year, COUNT(*) AS prechurn FROM signals
        {_where(f"customer_action IN {_in(PRECHURN_ACTIONS)}", flt)} GROUP BY year""")


def sql_competitive_benchmark(flt: str = "", min_count: int = 500, limit: int = 15) -> str:
    return with_signals(f"""
        SELECT company, avg_sentiment FROM (
          SELECT company, AVG(sentiment_score) AS avg_sentiment FROM signals
          {_where("sentiment_score IS NOT NULL", flt)}
          GROUP BY company HAVING COUNT(*) > {min_count}) a
        ORDER BY avg_sentiment ASC, company ASC NULLS FIRST LIMIT {limit}""")


def sql_company_product_heatmap(flt: str = "", pair_limit: int = 500, product_limit: int = 8) -> str:
    return with_signals(f"""
        , pairs AS (SELECT company, product_service, AVG(sentiment_score) AS avg_sentiment,
                           COUNT(*) AS n FROM signals {_where(flt)} GROUP BY company, product_service),
        top AS (SELECT * FROM pairs ORDER BY n DESC, company ASC NULLS FIRST,
                product_service ASC NULLS FIRST LIMIT {pair_limit}),
        prods AS (SELECT product_service FROM top WHERE product_service IS NOT NULL
                  GROUP BY product_service ORDER BY COUNT(avg_sentiment) DESC, product_service ASC
                  LIMIT {product_limit})
        SELECT company, product_service, avg_sentiment FROM top
        WHERE product_service IN (SELECT product_service FROM prods)""".replace(
        "\n        , pairs AS", "WITH pairs AS", 1))


def sql_escalation_rate(flt: str = "") -> str:
    return with_signals(f"""
        SELECT complaining, formal_complaint,
               {pct_round_sql('formal_complaint', 'complaining + formal_complaint')} AS escalation_rate
        FROM (SELECT COUNT(*) FILTER (WHERE customer_action = 'complaining') AS complaining,
                     COUNT(*) FILTER (WHERE customer_action = 'formal_complaint') AS formal_complaint
              FROM signals {_where(f"customer_action IN {_in(COMPLAINT_ACTIONS)}", flt)}) a""")


def sql_behavior_cycle(flt: str = "") -> str:
    return with_signals(f"""
        SELECT companies, {ratio_round_sql('COALESCE(total_days, 0)', 'companies')} AS avg_days FROM (
          SELECT CAST(SUM(date_diff('day', date_neg, date_churn)) AS BIGINT) AS total_days,
                 COUNT(*) AS companies FROM (
            SELECT company,
                   MIN(CASE WHEN sentiment_label = 'negative' THEN date END) AS date_neg,
                   MAX(CASE WHEN customer_action ILIKE 'churning%' THEN date END) AS date_churn
            FROM signals {_where(flt)} GROUP BY company) c
          WHERE date_neg IS NOT NULL AND date_churn IS NOT NULL AND date_churn > date_neg) a""")


def sql_product_risk(flt: str = "", limit: int = 10) -> str:
    raw = ("(CAST(neg AS DOUBLE) * 1.0 / vol) * 40 + (CAST(churn AS DOUBLE) * 1.0 / vol) * 40"
           " + (CAST(vol AS DOUBLE) / mx) * 20")
    return with_signals(f"""
        , p AS (SELECT product_service AS product,
                       COUNT(*) FILTER (WHERE sentiment_label = 'negative') AS neg,
                       COUNT(*) FILTER (WHERE customer_action ILIKE 'churning%') AS churn,
                       COUNT(*) AS vol
                FROM signals {_where(flt)} GROUP BY product_service),
        m AS (SELECT MAX(vol) AS mx FROM p)
        SELECT product, LEAST(GREATEST({numpy_round_sql(raw)}, 0.0), 100.0) AS score
        FROM p, m ORDER BY score DESC, product ASC NULLS FIRST LIMIT {limit}""".replace(
        "\n        , p AS", "WITH p AS", 1))


def _sql_topics(topics, label: str, base: str, flt: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS {label}, COUNT(*) FILTER (WHERE regexp_matches(lower(COALESCE(text, '')), '{rx}')) AS Frecuencia FROM s"
        for name, rx in topics)
    return with_signals(f"""
        , s AS (SELECT text FROM signals {_where(base, flt)})
        {parts}""".replace("\n        , s AS", "WITH s AS", 1))


def sql_complaint_topics(flt: str = "") -> str:
    return _sql_topics(COMPLAINT_TOPICS, "Topic", "sentiment_label = 'negative'", flt)


def sql_app_issue_topics(flt: str = "") -> str:
    return _sql_topics(APP_ISSUE_TOPICS, "Problema", f"sentiment_label = 'negative' AND {MOBILE_SQL}", flt)


def sql_state_intensity(flt: str = "", limit: int = 20) -> str:
    return with_signals(f"""
        SELECT replace(replace(country, 'United States - ', ''), 'United States – ', '') AS estado,
               COUNT(*) AS quejas
        FROM signals {_where(f"customer_action IN {_in(COMPLAINT_ACTIONS)}", "country IS NOT NULL", flt)}
        GROUP BY 1 ORDER BY quejas DESC, estado ASC LIMIT {limit}""")


def _mobile_where(flt: str, reference_precedence: bool) -> str:
    if reference_precedence and flt:
        return (f"WHERE lower(source) LIKE '%appstore%' OR "
                f"(lower(source) LIKE '%google%play%' AND ({flt}))")
    return _where(MOBILE_SQL, flt)


def sql_device_comparison(flt: str = "", reference_precedence: bool = False) -> str:
    return with_signals(f"""
        SELECT source, AVG(rating) AS avg_rating, AVG(sentiment_score) AS avg_sentiment
        FROM signals {_mobile_where(flt, reference_precedence)} GROUP BY source""")


def sql_rating_distribution(flt: str = "") -> str:
    return with_signals(f"""
        , c AS (SELECT CAST(ROUND(rating) AS INTEGER) AS estrellas, COUNT(*) AS cantidad
                FROM signals {_where(MOBILE_SQL, "rating IS NOT NULL AND rating > 0", flt)}
                GROUP BY 1),
        d AS (SELECT CAST(range AS INTEGER) AS estrellas FROM range(1, 6))
        SELECT d.estrellas, CAST(COALESCE(c.cantidad, 0) AS BIGINT) AS cantidad,
               CAST(d.estrellas AS VARCHAR) || ' ★' AS estrella_label
        FROM d LEFT JOIN c ON d.estrellas = c.estrellas
        WHERE EXISTS (SELECT 1 FROM c)""".replace("\n        , c AS", "WITH c AS", 1))


def sql_yoy_volume_sentiment(flt: str = "", reference_precedence: bool = False) -> str:
    return with_signals(f"""
        SELECT year, COUNT(*) AS volumen, AVG(sentiment_score) AS avg_sentiment
        FROM signals {_mobile_where(flt, reference_precedence)} GROUP BY year""")


# ---------------------------------------------------------------------------
# Registry
# ---------------------------------------------------------------------------

_METRICS = [
    ("nps_proxy", M.nps_proxy, sql_nps_proxy),
    ("nps_breakdown", M.nps_breakdown, sql_nps_breakdown),
    ("complaint_velocity", M.complaint_velocity, sql_complaint_velocity),
    ("sentiment_by_channel", M.sentiment_by_channel, sql_sentiment_by_channel),
    ("monthly_activity", M.monthly_activity, sql_monthly_activity),
    ("source_impact", M.source_impact, sql_source_impact),
    ("churn_causes", M.churn_causes, sql_churn_causes),
    ("regulatory_exposure", M.regulatory_exposure, sql_regulatory_exposure),
    ("prechurn_trend", M.prechurn_trend, sql_prechurn_trend),
    ("competitive_benchmark", M.competitive_benchmark, sql_competitive_benchmark),
    ("company_product_heatmap", M.company_product_heatmap, sql_company_product_heatmap),
    ("escalation_rate", M.escalation_rate, sql_escalation_rate),
    ("behavior_cycle", M.behavior_cycle, sql_behavior_cycle),
    ("product_risk", M.product_risk, sql_product_risk),
    ("complaint_topics", M.complaint_topics, sql_complaint_topics),
    ("state_intensity", M.state_intensity, sql_state_intensity),
    ("device_comparison", M.device_comparison, sql_device_comparison),
    ("rating_distribution", M.rating_distribution, sql_rating_distribution),
    ("app_issue_topics", M.app_issue_topics, sql_app_issue_topics),
    ("yoy_volume_sentiment", M.yoy_volume_sentiment, sql_yoy_volume_sentiment),
]

# (name, metric, filter object, filter SQL, extra kwargs)
_FILTERED = [
    ("nps_proxy_filtered", M.nps_proxy, FILTER_A, SQL_FILTER_A, {}),
    ("complaint_velocity_filtered", M.complaint_velocity, FILTER_A, SQL_FILTER_A, {}),
    ("churn_causes_filtered", M.churn_causes, FILTER_B, SQL_FILTER_B, {}),
    ("competitive_benchmark_filtered", M.competitive_benchmark, FILTER_A, SQL_FILTER_A,
     {"min_count": 100}),
    ("company_product_heatmap_filtered", M.company_product_heatmap, FILTER_B, SQL_FILTER_B, {}),
    ("behavior_cycle_filtered", M.behavior_cycle, FILTER_A, SQL_FILTER_A, {}),
    ("product_risk_filtered", M.product_risk, FILTER_B, SQL_FILTER_B, {}),
    ("complaint_topics_filtered", M.complaint_topics, FILTER_A, SQL_FILTER_A, {}),
    ("state_intensity_filtered", M.state_intensity, FILTER_B, SQL_FILTER_B, {}),
    ("rating_distribution_filtered", M.rating_distribution, FILTER_C, SQL_FILTER_C, {}),
    ("device_comparison_filtered", M.device_comparison, FILTER_C, SQL_FILTER_C, {}),
    ("device_comparison_reference_precedence", M.device_comparison, FILTER_C, SQL_FILTER_C,
     {"reference_precedence": True}),
    ("yoy_volume_sentiment_reference_precedence", M.yoy_volume_sentiment, FILTER_C, SQL_FILTER_C,
     {"reference_precedence": True}),
]

_SQL_BY_METRIC = {fn: sql for _, fn, sql in _METRICS}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: _metric(fn) for name, fn, _ in _METRICS}
    for name, fn, f, _, kw in _FILTERED:
        out[name] = _metric(fn, f, **kw)
    from feedlens.plans import extra_catalog

    out.update(extra_catalog.queries())
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: sql() for name, _, sql in _METRICS}
    for name, fn, _, flt, kw in _FILTERED:
        out[name] = _SQL_BY_METRIC[fn](flt, **kw)
    from feedlens.plans import extra_catalog

    out.update(extra_catalog.oracle_sql())
    return out
