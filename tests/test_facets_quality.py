"""Facets (O1-O6) and profiles (Q1-Q6) on literal frames and properties."""

from pyspark.sql import functions as F

from feedlens.operators import quality as Q
from feedlens.operators.facets import facet_counts, facet_options, year_bounds
from feedlens.operators.filters import SignalFilter
from feedlens.schema import SIGNALS_SCHEMA


def frame(spark, rows):
    names = SIGNALS_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SIGNALS_SCHEMA)


def test_thresholds_are_inclusive_and_labels(spark):
    long_co = "C" * 46
    rows = ([{"year": 2020, "source": "S100", "customer_action": "venting"}] * 100
            + [{"year": 2021, "source": "S99", "customer_action": "bogus"}] * 99
            + [{"year": 2021, "company": long_co, "product_service": "P" * 50}] * 1000)
    opts = facet_options(frame(spark, rows)).collect()
    by = {(r.dim, r.value): r for r in opts}
    assert ("source", "S100") in by and ("source", "S99") not in by
    assert by[("source", "S100")].label == "S100 (100)"
    assert by[("company", long_co)].label == "C" * 45 + "… (1,000)"
    assert by[("product", "P" * 50)].label == "P" * 50 + " (1,000)"
    assert ("action", "venting") in by and ("action", "bogus") not in by
    assert [r.value for r in opts if r.dim == "year"] == ["2020", "2021"]


def test_leave_one_out(spark):
    rows = ([{"year": 2020, "source": "A"}] * 150 + [{"year": 2021, "source": "B"}] * 120)
    f = SignalFilter(sources=("A",), years=(2021,))
    by = {(r.dim, r.value): r.cnt for r in facet_counts(frame(spark, rows), f).collect()}
    # year options ignore the year filter but keep the source filter, and vice versa
    assert by == {("year", "2020"): 150, ("source", "B"): 120}


def test_no_filter_equals_plain_group_counts(spark):
    from feedlens.plans.testbed import signals_from_tables

    sig = signals_from_tables(spark, "/root/testdata/sf0.001")
    got = {r.value: r.cnt for r in facet_counts(sig).where(F.col("dim") == "company").collect()}
    want = {r.company: r["count"] for r in sig.groupBy("company").count().collect()}
    assert got == want


def test_year_bounds(spark):
    rows = [{"year": y} for y in (2018, 2019, 2020)]
    got = [(r.year, r.from_disabled, r.to_disabled)
           for r in year_bounds(facet_options(frame(spark, rows)), 2019, 2019).collect()]
    assert got == [(2018, False, True), (2019, False, False), (2020, True, False)]


def test_caps_and_tab_allow_list(spark):
    rows = []
    for i in range(35):
        rows += [{"company": f"Co{i:02d}", "source": "CFPB" if i % 2 else "Reddit"}] * (500 + i)
    opts = facet_options(frame(spark, rows), tab="retention").collect()
    cos = [r.value for r in opts if r.dim == "company"]
    assert len(cos) == 30 and cos[0] == "Co34"
    assert [r.value for r in opts if r.dim == "source"] == ["CFPB"]


def test_quality_profiles(spark):
    rows = [{"source": "App Store", "rating": 4.0, "company": "b"},
            {"source": "AppStore", "rating": None, "company": "a"},
            {"source": "Reddit", "company": None, "year": 2020}]
    sig = frame(spark, rows)
    nn = Q.non_null_counts(sig).first()
    assert nn.nn_company == 2 and nn.nn_rating == 1
    assert [r.value for r in Q.distinct_sample(sig, ("company",)).collect()] == [None, "a", "b"]
    cov = {r.source: r for r in Q.coverage_by_source(sig).collect()}
    assert cov["AppStore"].with_rating == 0 and cov["App Store"].total == 1
    mob = {r.source: r.rating_count for r in Q.mobile_rating_profile(sig).collect()}
    assert mob == {"App Store": 1, "AppStore": 0}
    assert Q.rows_by_year_for_source(sig, "Reddit").first().rows == 1
    assert {r.source: r.rows for r in Q.rows_by_source(sig).collect()}["Reddit"] == 1
