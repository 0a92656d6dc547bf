"""Metric unit tests on literal frames (traps of SURVEY 7.4) and sf0.01 anchors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedlens.operators import derived as V
from feedlens.operators import metrics as M
from feedlens.operators.filters import SignalFilter
from feedlens.plans.testbed import signals_from_tables
from feedlens.schema import SIGNALS_SCHEMA

D = dt.date


def frame(spark, rows):
    """Rows as dicts over the signal schema; missing keys are NULL."""
    names = SIGNALS_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SIGNALS_SCHEMA)


@pytest.fixture(scope="module")
def sig01(spark):
    s = signals_from_tables(spark, "/root/testdata/sf0.01").cache()
    yield s
    s.unpersist()


# ---- rounding / NPS ---------------------------------------------------------

def test_nps_empty_is_zero(spark):
    r = M.nps_proxy(frame(spark, [])).first()
    assert (r.total_signals, r.promoters, r.passives, r.detractors) == (0, 0, 0, 0)
    assert (r.pct_promoters, r.pct_detractors, r.nps_score) == (0.0, 0.0, 0.0)


def test_nps_nulls_are_passive_and_score_from_rounded(spark):
    rows = ([{"sentiment_label": "positive"}] * 3 + [{"sentiment_label": "negative"}] * 1
            + [{"sentiment_label": None}, {"sentiment_label": "weird"}, {}])
    r = M.nps_proxy(frame(spark, rows)).first()
    assert (r.promoters, r.passives, r.detractors, r.total_signals) == (3, 3, 1, 7)
    assert r.pct_promoters == 42.9 and r.pct_detractors == 14.3
    assert r.nps_score == 28.6  # 42.9 - 14.3 from the rounded shares
    b = {x.Segmento: x for x in M.nps_breakdown(frame(spark, rows)).collect()}
    assert b["Pasivos"].Cantidad == 3 and b["Promotores"].share_pct == 42.9


def test_exact_half_even_at_a_tie(spark):
    # 1 of 16 = 6.25 %: an exact tie at one decimal -> half-even 6.2
    rows = [{"sentiment_label": "positive"}] + [{"sentiment_label": "neutral"}] * 15
    assert M.nps_proxy(frame(spark, rows)).first().pct_promoters == 6.2


# ---- quarters, escalation, cycle ---------------------------------------------

def test_quarter_null_month_goes_to_q4(spark):
    months = [1, 3, 4, 6, 7, 9, 10, 12, None]
    rows = [{"year": 2020, "month": m, "customer_action": "venting"} for m in months]
    got = {(r.quarter, r.quejas) for r in M.complaint_velocity(frame(spark, rows)).collect()}
    assert got == {("Q1", 2), ("Q2", 2), ("Q3", 2), ("Q4", 3)}
    assert M.complaint_velocity(frame(spark, rows)).first().periodo == "2020 Q1"


def test_escalation_rate_cases(spark):
    assert M.escalation_rate(frame(spark, [{"customer_action": "venting"}])).first().escalation_rate == 0.0
    one = [{"customer_action": "complaining"}] * 2
    assert M.escalation_rate(frame(spark, one)).first().escalation_rate == 0.0
    both = one + [{"customer_action": "formal_complaint"}]
    assert M.escalation_rate(frame(spark, both)).first().escalation_rate == 33.3


def test_behavior_cycle_cases(spark):
    rows = [
        # A: churn 10 days after the first negative
        {"company": "A", "date": D(2020, 1, 1), "sentiment_label": "negative"},
        {"company": "A", "date": D(2020, 1, 5), "sentiment_label": "negative"},
        {"company": "A", "date": D(2020, 1, 11), "customer_action": "CHURNING_due_to_price"},
        # B: churn before the negative -> excluded
        {"company": "B", "date": D(2020, 1, 1), "customer_action": "churning"},
        {"company": "B", "date": D(2020, 2, 1), "sentiment_label": "negative"},
        # C: same day -> excluded
        {"company": "C", "date": D(2020, 1, 1), "customer_action": "churning",
         "sentiment_label": "negative"},
        # D: no churn; NULL company: 3 days
        {"company": "D", "date": D(2020, 1, 1), "sentiment_label": "negative"},
        {"company": None, "date": D(2020, 1, 1), "sentiment_label": "negative"},
        {"company": None, "date": D(2020, 1, 4), "customer_action": "churning"},
    ]
    r = M.behavior_cycle(frame(spark, rows)).first()
    assert r.companies == 2 and r.avg_days == 6.5
    assert M.behavior_cycle(frame(spark, rows[3:6])).first().avg_days == 0.0


# ---- stars -------------------------------------------------------------------

def test_rating_distribution_half_away_and_zero_fill(spark):
    ratings = [0.0, 0.4, 0.5, 2.5, 5.4, 5.5, None]
    rows = [{"source": "AppStore", "rating": x} for x in ratings] + [{"source": "Reddit", "rating": 3.0}]
    got = [(r.estrellas, r.cantidad, r.estrella_label)
           for r in M.rating_distribution(frame(spark, rows)).collect()]
    assert got == [(1, 1, "1 ★"), (2, 0, "2 ★"), (3, 1, "3 ★"), (4, 0, "4 ★"), (5, 1, "5 ★")]


def test_rating_distribution_empty_input_is_empty(spark):
    rows = [{"source": "Reddit", "rating": 3.0}, {"source": "AppStore", "rating": 0.0}]
    assert M.rating_distribution(frame(spark, rows)).count() == 0
    only_zero_star = [{"source": "AppStore", "rating": 0.3}]
    got = M.rating_distribution(frame(spark, only_zero_star)).collect()
    assert [r.cantidad for r in got] == [0, 0, 0, 0, 0]


def test_mobile_predicate_and_rating_mean_includes_zero(spark):
    rows = [{"source": "Google Play", "rating": 0.0, "sentiment_score": 0.5},
            {"source": "Google Play", "rating": 4.0, "sentiment_score": 0.5},
            {"source": "App Store", "rating": 5.0}]
    got = {r.source: r.avg_rating for r in M.device_comparison(frame(spark, rows)).collect()}
    assert got == {"Google Play": 2.0}  # 'App Store' with a space is not mobile


def test_device_comparison_without_rating_column(spark):
    df = frame(spark, [{"source": "AppStore", "sentiment_score": 0.5}]).drop("rating")
    assert M.device_comparison(df).columns == ["source", "avg_sentiment"]


def test_topics_multilabel_substring(spark):
    rows = [{"sentiment_label": "negative", "text": "Nice coffee"},
            {"sentiment_label": "negative", "text": "billing and SUPPORT"},
            {"sentiment_label": "negative", "text": None},
            {"sentiment_label": "positive", "text": "fee"}]
    got = {r.Topic: r.Frecuencia for r in M.complaint_topics(frame(spark, rows)).collect()}
    assert len(got) == 6
    assert got["Cobros / Cargos Incorrectos"] == 2 and got["Atención al Cliente"] == 1


def test_state_prefixes_removed(spark):
    rows = [{"customer_action": "complaining", "country": "United States - Ohio"},
            {"customer_action": "formal_complaint", "country": "United States – Ohio"},
            {"customer_action": "complaining", "country": None},
            {"customer_action": "venting", "country": "United States - Utah"}]
    assert [(r.estado, r.quejas) for r in M.state_intensity(frame(spark, rows)).collect()] == [("Ohio", 2)]


def test_product_risk_and_churn_ilike(spark):
    rows = ([{"product_service": "P", "sentiment_label": "negative", "customer_action": "Churning"}] * 2
            + [{"product_service": "Q", "sentiment_label": "positive"}] * 4)
    got = {r.product: r.score for r in M.product_risk(frame(spark, rows)).collect()}
    assert got == {"P": 90.0, "Q": 20.0}


def test_heatmap_drops_null_product_from_ranking(spark):
    rows = [{"company": "A", "product_service": None, "sentiment_score": 0.0},
            {"company": "A", "product_service": "X", "sentiment_score": 1.0}]
    got = [(r.company, r.product_service) for r in M.company_product_heatmap(frame(spark, rows)).collect()]
    assert got == [("A", "X")]
    cells = V.heatmap_cells(M.company_product_heatmap(frame(spark, rows))).collect()
    assert cells[0].sat_score == 100.0


def test_filters_null_never_passes_and_precedence(spark):
    rows = [{"source": "AppStore", "year": 1990, "sentiment_score": 1.0},
            {"source": "GooglePlay", "year": 1990, "sentiment_score": 1.0},
            {"source": "GooglePlay", "year": 2000, "sentiment_score": 0.0},
            {"source": None, "year": 2000}]
    f = SignalFilter(period=(1999, 2001))
    ours = {r.source: r.volumen for r in
            M.yoy_volume_sentiment(frame(spark, rows), f).groupBy().agg(F.sum("volumen").alias("volumen"))
            .select(F.lit("all").alias("source"), "volumen").collect()}
    assert ours == {"all": 1}
    ref = M.yoy_volume_sentiment(frame(spark, rows), f, reference_precedence=True).collect()
    assert sum(r.volumen for r in ref) == 2  # the AppStore row bypasses the filter


def test_filter_algebra_helpers():
    f = SignalFilter.from_period("anios_meses", years=[2020], months=[1, 2], sources=["CFPB", "Reddit"],
                                 companies=["X"], sentiment="Negative")
    assert f.years == (2020,) and f.months == (1, 2)
    assert SignalFilter.from_period("rango").period == (2010, 2027)
    assert SignalFilter.from_period("anios", months=[1]).months is None
    t = f.for_tab("product")
    assert t.sources is None and t.companies is None and t.sentiment == "Negative"
    r = f.for_tab("retention")
    assert r.sources == ("CFPB",) and r.companies is None
    assert SignalFilter(sources=("Reddit",)).for_tab("retention").sources is None
    assert f.without("sources").sources is None
    assert SignalFilter(sentiment="ALL").predicate() is None
    assert "sentiment_label = 'negative'" in f.sql()


# ---- anchors at sf0.01 (values seen in both Spark and DuckDB) -----------------

def test_anchors_sf001(spark, sig01):
    assert sig01.count() == 60000
    m3 = M.sentiment_by_channel(sig01).first()
    assert (m3.source, m3.avg_sentiment) == ("AppStore", 0.020187788752588816)
    m9 = M.competitive_benchmark(sig01).first()
    assert (m9.company, m9.avg_sentiment) == ("Supplier#000000022", -0.018114203454894433)
    assert M.competitive_benchmark(sig01, limit=1000).count() == 70
    m12 = M.behavior_cycle(sig01).first()
    # Spark and DuckDB both give 2468.94 days with the case-insensitive match
    # (2461.65 with a case-sensitive LIKE); FIXTURES.md lists 2450.88, which
    # neither engine reproduces from the documented projection.
    assert m12.companies == 100 and m12.avg_days == 2468.9
    topics = {r.Topic: r.Frecuencia for r in M.complaint_topics(sig01).collect()}
    assert topics["Cobros / Cargos Incorrectos"] == 6575
    # the fixture anchors apply the app-issue patterns to ALL negative rows
    from feedlens.functions.text import topic_counts
    from feedlens.schema import APP_ISSUE_TOPICS
    neg = sig01.where(F.col("sentiment_label") == "negative")
    issues = {r.topic: r.frequency for r in topic_counts(neg, APP_ISSUE_TOPICS).collect()}
    assert issues["Lentitud (Slow)"] == 2164 and issues["Fallas (Crash)"] == 4300
    m15 = M.state_intensity(sig01).first()
    assert (m15.estado, m15.quejas) == ("Unknown", 612)
    stars = {r.estrellas: r.cantidad for r in M.rating_distribution(sig01).collect()}
    assert (stars[1], stars[2], stars[3]) == (2054, 2081, 2028)
    f99 = SignalFilter(period=(1999, 1999))
    par = M.yoy_volume_sentiment(sig01, f99).agg(F.sum("volumen")).first()[0]
    ref = M.yoy_volume_sentiment(sig01, f99, reference_precedence=True).agg(F.sum("volumen")).first()[0]
    assert (par, ref) == (2111, 8475)
