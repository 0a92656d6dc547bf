"""Fused (one grouping-sets scan) bundles equal the per-metric bundles."""

import pytest

from feedlens.operators.filters import SignalFilter
from feedlens.plans import bundles as B
from feedlens.plans.testbed import signals_from_tables

FILTERS = [None,
           SignalFilter(period=(1994, 1997), sources=("Reddit", "CFPB", "AppStore", "GooglePlay")),
           SignalFilter(years=(1800,))]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def sig(spark):
    s = signals_from_tables(spark, "/root/testdata/sf0.01").cache()
    yield s
    s.unpersist()


@pytest.mark.parametrize("name", sorted(B.BUNDLES))
@pytest.mark.parametrize("fi", range(len(FILTERS)))
def test_fused_equals_per_metric(sig, name, fi):
    f = FILTERS[fi]
    with B.BUNDLES[name](sig, f, fused=True) as a, B.BUNDLES[name](sig, f, fused=False) as b:
        assert set(a) == set(b)
        for key in a:
            assert a[key].columns == b[key].columns, key
            assert _rows(a[key]) == _rows(b[key]), key


def test_product_reference_precedence(sig):
    f = SignalFilter(period=(1999, 1999))
    with B.product(sig, f, reference_precedence=True) as a, \
            B.product(sig, f, fused=False, reference_precedence=True) as b:
        for key in a:
            assert _rows(a[key]) == _rows(b[key]), key
        assert sum(r.volumen for r in a["yoy_volume_sentiment"].collect()) == 8475


def test_collect_runs_all_tables(sig):
    f = SignalFilter(period=(1994, 1997))
    with B.retention(sig, f) as b:
        got = b.collect()
        assert set(got) == set(b)
        assert sorted(map(tuple, got["state_intensity"]), key=repr) == _rows(b["state_intensity"])


@pytest.mark.parametrize("aggregate", ["retention_aggregate", "product_aggregate"])
def test_text_is_lowered_once_and_scanned_once(spark, tmp_path, aggregate):
    from feedlens.plans import fused

    path = str(tmp_path / "signals")
    signals_from_tables(spark, "/root/testdata/sf0.001").write.parquet(path)
    plan = getattr(fused, aggregate)(spark.read.parquet(path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(coalesce(text") == 1
    assert plan.count("Relation [") == 1
