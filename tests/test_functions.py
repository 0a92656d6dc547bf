"""Column helpers: keyword matching, exact rounding, size-checked broadcast."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedlens.functions.rounding import numpy_round, pct_round
from feedlens.functions.text import keyword_match
from feedlens.operators.joins import broadcast_if_small, estimated_bytes
from feedlens.schema import APP_ISSUE_TOPICS, COMPLAINT_TOPICS

PATTERNS = [rx for _, rx in COMPLAINT_TOPICS + APP_ISSUE_TOPICS]
WORDS = sorted({w for rx in PATTERNS for w in rx.split("|")})
pieces = st.one_of(st.sampled_from(WORDS), st.text(alphabet="abcdeílnoprstuy ,.", max_size=6))
texts = st.lists(pieces, max_size=6).map(lambda ps: "".join(ps).lower())


@settings(max_examples=25, deadline=None)
@given(st.lists(texts, min_size=1, max_size=20))
def test_keyword_match_equals_regex_search(spark, batch):
    df = spark.createDataFrame([(t,) for t in batch], "text string")
    cols = [keyword_match(F.col("text"), rx).alias(f"p{i}") for i, rx in enumerate(PATTERNS)]
    got = [tuple(r) for r in df.select(*cols).collect()]
    want = [tuple(re.search(rx, t) is not None for rx in PATTERNS) for t in batch]
    assert got == want


def test_keyword_match_falls_back_to_regex(spark):
    df = spark.createDataFrame([("abc",), ("xbz",)], "text string")
    assert [r[0] for r in df.select(keyword_match(F.col("text"), "a.c")).collect()] == [True, False]


def test_rounding_helpers(spark):
    import numpy as np

    xs = [2.675, 1.005, 0.25, 0.35, -2.5, 33.35, 12.345, 1e-9, 99.95]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for d in (0, 1, 2):
        got = [r[0] for r in df.select(numpy_round(F.col("x"), d)).collect()]
        assert got == [float(np.round(x, d)) for x in xs], d
    fr = spark.createDataFrame([(1, 16), (1, 8), (2, 3), (0, 0)], "n long, d long")
    got = [r[0] for r in fr.select(pct_round(F.col("n"), F.col("d"))).collect()]
    assert got == [6.2, 12.5, 66.7, 0.0]  # exact half-even on the rational; 0.0 when d = 0


def test_broadcast_if_small(spark, tmp_path):
    for name, n in (("small", 10), ("big", 200_000)):
        spark.range(n).write.parquet(str(tmp_path / name))
    small, big = (spark.read.parquet(str(tmp_path / n)) for n in ("small", "big"))
    limit = (estimated_bytes(small) + estimated_bytes(big)) // 2
    fact = spark.range(1000).withColumnRenamed("id", "k")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [fact.join(broadcast_if_small(d, limit), fact.k == d.id) for d in (small, big)]
        text = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in text[0] and "BroadcastHashJoin" not in text[1]
    assert [p.count() for p in plans] == [10, 1000]


def test_nps_segments_add_up(spark):
    from feedlens.operators.metrics import nps_proxy
    from feedlens.plans.testbed import signals_from_tables

    r = nps_proxy(signals_from_tables(spark, "/root/testdata/sf0.001")).first()
    assert r.promoters + r.passives + r.detractors == r.total_signals
