"""Registered queries for facets, profiles and derived views, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedlens.functions.rounding import numpy_round_sql
from feedlens.operators import derived as V
from feedlens.operators import metrics as M
from feedlens.operators import profiles as P
from feedlens.operators import quality as Q
from feedlens.operators.facets import facet_options, year_bounds
from feedlens.operators.filters import SignalFilter
from feedlens.plans import catalog as C
from feedlens.plans import ingest_catalog as I
from feedlens.plans.testbed import signals_from_tables, with_signals
from feedlens.schema import VALID_ACTIONS

FACET_FILTER = SignalFilter(period=(1994, 1998), sources=("Reddit", "CFPB", "AppStore"),
                            companies=("Supplier#000000001", "Supplier#000000002",
                                       "Supplier#000000003"),
                            actions=("complaining", "formal_complaint", "venting", "churning"),
                            sentiment="negative")


def _sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals_from_tables(spark, sf_dir)


def _sub(sql: str) -> str:
    """A metric's oracle SQL as a subquery."""
    return f"({sql})"


# --- facets ---------------------------------------------------------------

# Conditions of FACET_FILTER by option list, its own condition left out, written by hand.
_YEARS, _ACTIONS = "year >= 1994 AND year <= 1998", "customer_action IN ('complaining', 'formal_complaint', 'venting', 'churning')"
_NEGATIVE, _COMPANIES = "sentiment_label = 'negative'", "company IN ('Supplier#000000001', 'Supplier#000000002', 'Supplier#000000003')"
_SOURCES, _RETENTION_SOURCES = "source IN ('Reddit', 'CFPB', 'AppStore')", "source = 'CFPB'"
FACETS_ALL = dict.fromkeys(("year", "source", "company", "product", "action"), "true")
FACETS_FILTERED = {
    "year": f"{_SOURCES} AND {_COMPANIES} AND {_ACTIONS} AND {_NEGATIVE}",
    "source": f"{_YEARS} AND {_COMPANIES} AND {_ACTIONS} AND {_NEGATIVE}",
    "company": f"{_YEARS} AND {_SOURCES} AND {_ACTIONS} AND {_NEGATIVE}",
    "product": f"{_YEARS} AND {_SOURCES} AND {_COMPANIES} AND {_ACTIONS} AND {_NEGATIVE}",
    "action": f"{_YEARS} AND {_SOURCES} AND {_COMPANIES} AND {_NEGATIVE}",
}
# the retention tab hides companies and offers CFPB and Trustpilot
FACETS_RETENTION = {
    "year": f"{_RETENTION_SOURCES} AND {_ACTIONS} AND {_NEGATIVE}",
    "source": f"{_YEARS} AND {_ACTIONS} AND {_NEGATIVE} AND source IN ('CFPB', 'Trustpilot')",
    "company": f"{_YEARS} AND {_RETENTION_SOURCES} AND {_ACTIONS} AND {_NEGATIVE}",
    "product": f"{_YEARS} AND {_RETENTION_SOURCES} AND {_ACTIONS} AND {_NEGATIVE}",
    "action": f"{_YEARS} AND {_RETENTION_SOURCES} AND {_NEGATIVE}",
}


def sql_facets(where: dict[str, str]) -> str:
    """Option lists: smallest counts 1, 100, 500, 1000 and 10; 30 companies and 20 products at most."""
    valid = ", ".join(f"'{a}'" for a in VALID_ACTIONS)
    number = "' (' || format('{:,}', cnt) || ')'"
    return with_signals(f"""
        SELECT 'year' AS dim, CAST(year AS VARCHAR) AS value, COUNT(*) AS cnt, CAST(year AS VARCHAR) AS label
        FROM signals WHERE {where["year"]} GROUP BY year HAVING year IS NOT NULL
        UNION ALL
        SELECT 'source', source, cnt, source || {number} FROM (
            SELECT source, COUNT(*) AS cnt FROM signals WHERE {where["source"]} GROUP BY source) s
        WHERE cnt >= 100 AND source IS NOT NULL
        UNION ALL
        SELECT 'company', company, cnt, CASE WHEN length(company) > 45 THEN left(company, 45) || '…' ELSE company END || {number}
        FROM (SELECT company, COUNT(*) AS cnt FROM signals WHERE {where["company"]} AND company IS NOT NULL GROUP BY company
              HAVING COUNT(*) >= 500 ORDER BY cnt DESC, company LIMIT 30) c
        UNION ALL
        SELECT 'product', p, cnt, CASE WHEN length(p) > 50 THEN left(p, 50) || '…' ELSE p END || {number}
        FROM (SELECT product_service AS p, COUNT(*) AS cnt FROM signals WHERE {where["product"]} AND product_service IS NOT NULL
              GROUP BY product_service HAVING COUNT(*) >= 1000 ORDER BY cnt DESC, p LIMIT 20) q
        UNION ALL
        SELECT 'action', customer_action, cnt, customer_action || {number} FROM (
            SELECT customer_action, COUNT(*) AS cnt FROM signals WHERE {where["action"]} GROUP BY customer_action) a
        WHERE cnt >= 10 AND customer_action IN ({valid})""")


def q_facets(f=None, tab=None):
    def run(spark, sf_dir):
        return facet_options(_sig(spark, sf_dir), f, tab=tab)
    return run


def q_year_bounds(spark, sf_dir):
    return year_bounds(facet_options(_sig(spark, sf_dir), dimensions=["year"]), 1994, 1997)


def sql_year_bounds() -> str:
    return with_signals("""
        SELECT year, CAST(year AS VARCHAR) AS label, year > 1997 AS from_disabled,
               year < 1994 AS to_disabled
        FROM (SELECT DISTINCT year FROM signals WHERE year IS NOT NULL) y""")


# --- the same from counts kept with the datasets ----------------------------

def q_profiled(fn):
    """A query on the counts of a store of three datasets, one of which was loaded after the others were counted."""
    def run(spark, sf_dir):
        return fn(I.counted_store(spark, sf_dir).profiles())
    return run


# --- quality --------------------------------------------------------------

def sql_non_null_counts() -> str:
    from feedlens.schema import SIGNAL_COLUMNS
    cols = ["dataset_id", *SIGNAL_COLUMNS]
    return with_signals("SELECT " + ", ".join(f"COUNT({c}) AS nn_{c}" for c in cols) + " FROM signals")


def sql_distinct_sample() -> str:
    parts = [f"SELECT * FROM (SELECT DISTINCT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value "
             f"FROM signals ORDER BY value ASC NULLS FIRST LIMIT 5) s_{c}"
             for c in ("company", "product_service")]
    return with_signals(" UNION ALL ".join(parts))


SQL_COVERAGE = with_signals("""
    SELECT source, CAST(SUM(one) AS BIGINT) AS total, CAST(SUM(has_score) AS BIGINT) AS with_sentiment,
           CAST(SUM(has_rating) AS BIGINT) AS with_rating, CAST(SUM(has_company) AS BIGINT) AS with_company,
           CAST(SUM(has_product) AS BIGINT) AS with_product
    FROM (SELECT source, 1 AS one, CAST(sentiment_score IS NOT NULL AS INT) AS has_score,
                 CAST(rating IS NOT NULL AS INT) AS has_rating, CAST(company IS NOT NULL AS INT) AS has_company,
                 CAST(product_service IS NOT NULL AS INT) AS has_product FROM signals) flags
    GROUP BY source""")
SQL_MOBILE_RATING = with_signals("""
    SELECT s.source, CAST(list_count(ratings) AS BIGINT) AS rating_count, list_avg(ratings) AS avg_rating
    FROM (SELECT source, list(rating) AS ratings FROM signals
          WHERE regexp_matches(source, '^(app *store|google *play)$', 'i') GROUP BY source) s""")
SQL_YEARS_GOOGLEPLAY = with_signals(
    "SELECT year, COUNT(*) AS rows FROM signals WHERE source = 'GooglePlay' GROUP BY year")
SQL_ROWS_BY_SOURCE = with_signals("SELECT source, COUNT(*) AS rows FROM signals GROUP BY source")
SQL_ROWS_BY_DATASET = with_signals("SELECT dataset_id, COUNT(*) AS rows FROM signals GROUP BY dataset_id")


# --- derived --------------------------------------------------------------

def sql_benchmark_satisfaction(flt: str = "") -> str:
    sat = numpy_round_sql("(avg_sentiment + 1) / 2 * 100", 1)
    return f"""SELECT company, avg_sentiment, sat_score,
        CASE WHEN sat_score < 40 THEN 'danger' WHEN sat_score < 55 THEN 'warning' ELSE 'success' END AS band
        FROM (SELECT company, avg_sentiment, {sat} AS sat_score
              FROM {_sub(C.sql_competitive_benchmark(flt))} m) s"""


def sql_channel_bands(flt: str = "") -> str:
    return f"""SELECT source, avg_sentiment,
        CASE WHEN avg_sentiment < 0 THEN 'danger' WHEN avg_sentiment < 0.1 THEN 'warning'
             ELSE 'success' END AS band
        FROM {_sub(C.sql_sentiment_by_channel(flt))} m"""


def sql_heatmap_cells(flt: str = "") -> str:
    sat = numpy_round_sql("(avg_sentiment + 1) / 2 * 100", 0)
    cells = (f"SELECT company, product_service, {sat} AS sat_score "
             f"FROM {_sub(C.sql_company_product_heatmap(flt))} h WHERE company IS NOT NULL")
    return f"""SELECT company, product_service, sat_score FROM ({cells}) c
        WHERE company IN (SELECT company FROM ({cells}) c2 GROUP BY company
                          ORDER BY COUNT(sat_score) DESC, company ASC LIMIT 8)
          AND product_service IS NOT NULL AND sat_score IS NOT NULL"""


HEATMAP_PRODUCTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def sql_heatmap_matrix(flt: str = "") -> str:
    cols = ", ".join(f"AVG(CASE WHEN product_service = '{p}' THEN sat_score END) AS \"{p}\"" for p in HEATMAP_PRODUCTS)
    return f"SELECT company, {cols} FROM ({sql_heatmap_cells(flt)}) c GROUP BY company"


def sql_device_scaled(flt: str = "") -> str:
    return f"""SELECT source, avg_rating, avg_sentiment, (avg_sentiment + 1) / 2 * 5 AS sentiment_5
        FROM {_sub(C.sql_device_comparison(flt))} m"""


def sql_prechurn_total(flt: str = "") -> str:
    return (f"SELECT CAST(COALESCE(SUM(prechurn), 0) AS BIGINT) AS prechurn_total "
            f"FROM {_sub(C.sql_prechurn_trend(flt))} m")


def sql_status(metric_sql: str, title: str) -> str:
    return f"""SELECT '{title}' AS title, COUNT(*) = 0 AS is_empty,
        CASE WHEN COUNT(*) = 0 THEN '{title} (Sin datos para la selección)' ELSE '{title}' END
        AS display_title FROM {_sub(metric_sql)} m"""


def sql_nps_band(flt: str = "") -> str:
    return f"""SELECT *, CASE WHEN total_signals = 0 THEN 'empty' WHEN nps_score >= 0 THEN 'success'
        ELSE 'danger' END AS band FROM {_sub(C.sql_nps_proxy(flt))} m"""


def sql_regulatory_band(flt: str = "") -> str:
    return f"""SELECT *, CASE WHEN total = 0 THEN 'empty' WHEN pct > 50 THEN 'danger'
        ELSE 'warning' END AS band FROM {_sub(C.sql_regulatory_exposure(flt))} m"""


# --- ingest and store round trips (S1-S10, C1-C7, R1) ------------------------------

def _write_testbed(spark: SparkSession, sf_dir: str, fmt: str, as_table: bool = False) -> str:
    """Write the derived table as ``fmt`` part files.

    ``as_table`` names the output folder with the format's extension, so
    ``SignalStore.ingest`` reads all its parts as ONE dataset (a folder without
    an extension is a staging folder, where S5 picks one best file).
    """
    from feedlens.session import scratch_path

    path = scratch_path(spark, f"testbed-{fmt}") + (f".{fmt}" if as_table else "")
    w = signals_from_tables(spark, sf_dir).drop("dataset_id").write
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def q_cleaned_roundtrip(fmt: str):
    """The derived table written as ``fmt`` files, read back and cleaned."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from feedlens.operators.clean import transform_and_clean
        from feedlens.sources import readers

        path = _write_testbed(spark, sf_dir, fmt)
        raw = {"csv": readers.read_csv, "json": readers.read_json,
               "parquet": readers.read_parquet}[fmt](spark, path)
        return transform_and_clean(raw)
    return run


SQL_CLEANED = with_signals("""
    SELECT date, year, month, customer_action, COALESCE(sentiment_score, 0.0) AS sentiment_score,
           sentiment_label, source, company, product_service, COALESCE(text, '') AS text,
           COALESCE(country, 'Unknown') AS country, COALESCE(rating, 0.0) AS rating
    FROM signals""")


def q_store_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads into a fresh store (S9 pre-shaped append, S7 CSV ingest): registry rows."""
    from feedlens.session import scratch_path
    from feedlens.sources.store import SignalStore

    store = SignalStore(spark, scratch_path(spark, "store"))
    store.append_table(signals_from_tables(spark, sf_dir).drop("dataset_id"), "testbed")
    store.ingest(_write_testbed(spark, sf_dir, "csv", as_table=True), name="testbed_csv")
    return store.datasets().select("id", "name", "row_count")


def q_streamed_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived table staged as CSV part files, imported by the file stream.

    Each staged file becomes one dataset; the union of all imported signals
    must equal the batch-cleaned table.
    """
    from feedlens.session import scratch_path
    from feedlens.sources.store import SignalStore
    from feedlens.streaming.staged_import import import_staged

    staging = _write_testbed(spark, sf_dir, "csv")
    store = SignalStore(spark, scratch_path(spark, "stream-store"))
    import_staged(spark, store, staging, checkpoint=scratch_path(spark, "stream-ckpt"))
    return store.signals().drop("dataset_id")


SQL_STORE_REGISTRY = with_signals("""
    SELECT CAST(1 AS BIGINT) AS id, 'testbed' AS name, COUNT(*) AS row_count FROM signals
    UNION ALL SELECT CAST(2 AS BIGINT), 'testbed_csv', COUNT(*) FROM signals""")


# --- fused bundles (one grouping-sets scan per tab), checked table by table ------

PRODUCT_SQL_FILTER_A = "year BETWEEN 1994 AND 1997"  # the product tab drops the source filter
# direction: mild enough that over 15 companies pass the benchmark's > 500 threshold
FILTER_D = SignalFilter(months=tuple(range(1, 12)))
SQL_FILTER_D = "month < 12"

BUNDLE_TABLES = {
    "marketing": {
        "nps": lambda flt: sql_nps_band(flt),
        "nps_breakdown": C.sql_nps_breakdown,
        "complaint_velocity": C.sql_complaint_velocity,
        "sentiment_by_channel": sql_channel_bands,
        "monthly_activity": C.sql_monthly_activity,
        "source_impact": C.sql_source_impact,
    },
    "direction": {
        "churn_causes": C.sql_churn_causes,
        "regulatory_exposure": lambda flt: sql_regulatory_band(flt),
        "prechurn_trend": C.sql_prechurn_trend,
        "prechurn_total": sql_prechurn_total,
        "competitive_benchmark": C.sql_competitive_benchmark,
        "benchmark_satisfaction": sql_benchmark_satisfaction,
        "company_product_heatmap": C.sql_company_product_heatmap,
        "heatmap_cells": sql_heatmap_cells,
        "heatmap_matrix": sql_heatmap_matrix,
    },
    "retention": {
        "escalation_rate": C.sql_escalation_rate,
        "behavior_cycle": C.sql_behavior_cycle,
        "product_risk": C.sql_product_risk,
        "complaint_topics": C.sql_complaint_topics,
        "state_intensity": C.sql_state_intensity,
    },
    "product": {
        "device_comparison": C.sql_device_comparison,
        "device_scaled": sql_device_scaled,
        "rating_distribution": C.sql_rating_distribution,
        "app_issue_topics": C.sql_app_issue_topics,
        "yoy_volume_sentiment": C.sql_yoy_volume_sentiment,
    },
}


# V8 by bundle: what makes a result empty, as SQL over the result.
_NONE, _FEW = "COUNT(*) = 0", "COUNT(*) < 3"


def _zero(*cols: str) -> str:
    return " + ".join(f"COALESCE(SUM({c}), 0)" for c in cols) + " = 0"


STATUS = {
    "marketing": {"nps": (C.sql_nps_proxy, _zero("total_signals")),
                  "complaint_velocity": (C.sql_complaint_velocity, _zero("quejas")),
                  "sentiment_by_channel": (C.sql_sentiment_by_channel, _NONE),
                  "monthly_activity": (C.sql_monthly_activity, _zero("volumen")),
                  "source_impact": (C.sql_source_impact, _zero("pct_positive", "pct_negative"))},
    "direction": {"churn_causes": (C.sql_churn_causes, _NONE),
                  "regulatory_exposure": (C.sql_regulatory_exposure, _zero("total")),
                  "prechurn_trend": (C.sql_prechurn_trend, _NONE),
                  "competitive_benchmark": (C.sql_competitive_benchmark, _NONE),
                  "company_product_heatmap": (C.sql_company_product_heatmap, _NONE)},
    "retention": {"escalation_rate": (C.sql_escalation_rate, _zero("escalation_rate")),
                  "behavior_cycle": (C.sql_behavior_cycle, _zero("avg_days")),
                  "product_risk": (C.sql_product_risk, _FEW),
                  "complaint_topics": (C.sql_complaint_topics, _zero("Frecuencia")),
                  "state_intensity": (C.sql_state_intensity, _zero("quejas"))},
    "product": {"device_comparison": (C.sql_device_comparison, _NONE),
                "rating_distribution": (C.sql_rating_distribution, _zero("cantidad")),
                "app_issue_topics": (C.sql_app_issue_topics, _zero("Frecuencia")),
                "yoy_volume_sentiment": (C.sql_yoy_volume_sentiment, _NONE)},
}


def sql_bundle_status(bundle: str, flt: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{key}' AS title, {empty} AS is_empty, CASE WHEN {empty}
        THEN '{key} (Sin datos para la selección)' ELSE '{key}' END AS display_title FROM ({sql(flt)}) t_{key}"""
        for key, (sql, empty) in STATUS[bundle].items())


def q_bundle_table(bundle: str, key: str, f: SignalFilter):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from feedlens.plans import bundles as B

        more = {"heatmap_products": HEATMAP_PRODUCTS} if bundle == "direction" else {}
        return B.BUNDLES[bundle](_sig(spark, sf_dir), f, persist=False, **more)[key]
    return run


def _bundle_queries() -> dict:
    tables = {f"bundle_{b}_{k}": q_bundle_table(b, k, FILTER_D if b == "direction" else C.FILTER_A)
              for b, tables in BUNDLE_TABLES.items() for k in [*tables, "status"]}
    return tables | {f"bundle_{b}_status_empty": q_bundle_table(b, "status", f) for b, (f, _) in SPARSE.items()}


def _bundle_oracles() -> dict:
    out = {}
    for b, tables in BUNDLE_TABLES.items():
        flt = {"product": PRODUCT_SQL_FILTER_A, "direction": SQL_FILTER_D}.get(b, C.SQL_FILTER_A)
        for k, sql in tables.items():
            out[f"bundle_{b}_{k}"] = sql(flt)
        out[f"bundle_{b}_status"] = sql_bundle_status(b, flt)
        out[f"bundle_{b}_status_empty"] = sql_bundle_status(b, SPARSE[b][1])
    return out


EMPTY_FILTER = SignalFilter(years=(1800,))
EMPTY_SQL = "year IN (1800)"
# Filters that leave nothing, or rows of two products and no complaint (fewer than three, all zero).
SPARSE = {
    "marketing": (EMPTY_FILTER, EMPTY_SQL), "direction": (EMPTY_FILTER, EMPTY_SQL), "product": (EMPTY_FILTER, EMPTY_SQL),
    "retention": (SignalFilter(products=("PROMO", "LARGE"), actions=("advocating",), sentiment="positive"),
                  "product_service IN ('PROMO', 'LARGE') AND customer_action = 'advocating' AND sentiment_label = 'positive'"),
}


def queries() -> dict:
    s = _sig
    return _bundle_queries() | I.queries() | {
        "filter_options": q_facets(),
        "filter_options_filtered": q_facets(FACET_FILTER),
        "filter_options_tab_retention": q_facets(FACET_FILTER.for_tab("retention"), tab="retention"),
        "year_bounds": q_year_bounds,
        "non_null_counts": lambda sp, d: Q.non_null_counts(s(sp, d)),
        "distinct_sample": lambda sp, d: Q.distinct_sample(s(sp, d)),
        "coverage_by_source": lambda sp, d: Q.coverage_by_source(s(sp, d)),
        "mobile_rating_profile": lambda sp, d: Q.mobile_rating_profile(s(sp, d)),
        "rows_by_year_googleplay": lambda sp, d: Q.rows_by_year_for_source(s(sp, d), "GooglePlay"),
        "rows_by_source": lambda sp, d: Q.rows_by_source(s(sp, d)),
        "rows_by_dataset": lambda sp, d: Q.rows_by_dataset(s(sp, d)),
        "filter_options_profiled": q_profiled(P.facet_options),
        "non_null_counts_profiled": q_profiled(P.non_null_counts),
        "coverage_by_source_profiled": q_profiled(P.coverage_by_source),
        "rows_by_year_googleplay_profiled": q_profiled(lambda p: P.rows_by_year_for_source(p, "GooglePlay")),
        "rows_by_source_profiled": q_profiled(P.rows_by_source),
        "benchmark_satisfaction": lambda sp, d: V.benchmark_satisfaction(M.competitive_benchmark(s(sp, d))),
        "channel_bands": lambda sp, d: V.channel_bands(M.sentiment_by_channel(s(sp, d))),
        "heatmap_cells": lambda sp, d: V.heatmap_cells(M.company_product_heatmap(s(sp, d))),
        "heatmap_matrix": lambda sp, d: V.heatmap_matrix(
            V.heatmap_cells(M.company_product_heatmap(s(sp, d))), HEATMAP_PRODUCTS),
        "device_scaled": lambda sp, d: V.device_scaled(M.device_comparison(s(sp, d))),
        "prechurn_total": lambda sp, d: V.prechurn_total(M.prechurn_trend(s(sp, d))),
        "churn_causes_status": lambda sp, d: V.status(M.churn_causes(s(sp, d)), "Churn"),
        "churn_causes_status_empty": lambda sp, d: V.status(M.churn_causes(s(sp, d), EMPTY_FILTER), "Churn"),
        "nps_band": lambda sp, d: V.nps_band(M.nps_proxy(s(sp, d))),
        "nps_band_empty": lambda sp, d: V.nps_band(M.nps_proxy(s(sp, d), EMPTY_FILTER)),
        "regulatory_band": lambda sp, d: V.regulatory_band(M.regulatory_exposure(s(sp, d))),
        "cleaned_csv_roundtrip": q_cleaned_roundtrip("csv"),
        "cleaned_json_roundtrip": q_cleaned_roundtrip("json"),
        "cleaned_parquet_roundtrip": q_cleaned_roundtrip("parquet"),
        "store_registry": q_store_registry,
        "streamed_import": q_streamed_import,
    }


def oracle_sql() -> dict:
    return _bundle_oracles() | I.oracle_sql() | {
        "filter_options": sql_facets(FACETS_ALL),
        "filter_options_filtered": sql_facets(FACETS_FILTERED),
        "filter_options_tab_retention": sql_facets(FACETS_RETENTION),
        "year_bounds": sql_year_bounds(),
        "non_null_counts": sql_non_null_counts(),
        "distinct_sample": sql_distinct_sample(),
        "coverage_by_source": SQL_COVERAGE,
        "mobile_rating_profile": SQL_MOBILE_RATING,
        "rows_by_year_googleplay": SQL_YEARS_GOOGLEPLAY,
        "rows_by_source": SQL_ROWS_BY_SOURCE,
        "rows_by_dataset": SQL_ROWS_BY_DATASET,
        "filter_options_profiled": sql_facets(FACETS_ALL),
        "non_null_counts_profiled": sql_non_null_counts(),
        "coverage_by_source_profiled": SQL_COVERAGE,
        "rows_by_year_googleplay_profiled": SQL_YEARS_GOOGLEPLAY,
        "rows_by_source_profiled": SQL_ROWS_BY_SOURCE,
        "benchmark_satisfaction": sql_benchmark_satisfaction(),
        "channel_bands": sql_channel_bands(),
        "heatmap_cells": sql_heatmap_cells(),
        "heatmap_matrix": sql_heatmap_matrix(),
        "device_scaled": sql_device_scaled(),
        "prechurn_total": sql_prechurn_total(),
        "churn_causes_status": sql_status(C.sql_churn_causes(), "Churn"),
        "churn_causes_status_empty": sql_status(C.sql_churn_causes(EMPTY_SQL), "Churn"),
        "nps_band": sql_nps_band(),
        "nps_band_empty": sql_nps_band(EMPTY_SQL),
        "regulatory_band": sql_regulatory_band(),
        "cleaned_csv_roundtrip": SQL_CLEANED,
        "cleaned_json_roundtrip": SQL_CLEANED,
        "cleaned_parquet_roundtrip": SQL_CLEANED,
        "store_registry": SQL_STORE_REGISTRY,
        "streamed_import": SQL_CLEANED,
    }
