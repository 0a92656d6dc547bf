"""op7: buckets that many short texts share by a common passage are compared by rare shingles, and lose no link."""

import random

from pyspark.sql import functions as F

import brute
from feedlens.llm import minhash_dedup as M


def texts(rng, n, passage=16, own=12, copies=60, known=50_000):
    """Texts with one passage in common, too little for a link, of which some have a near copy; and null and repeated ids."""
    shared = " ".join(f"p{i}" for i in range(passage))
    rows = [(i, shared + " " + " ".join(f"w{rng.randrange(known)}" for _ in range(own))) for i in range(n)]
    for i in range(copies):
        w = rng.choice(rows)[1].split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(passage, len(w))] = f"x{rng.randrange(1000)}"
        rows.append((n + i, " ".join(w)))
    return rows


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    rows, calls, crowded = texts(random.Random(5), 300), [], M._crowded
    monkeypatch.setattr(M, "CROWD", 3)
    monkeypatch.setattr(M, "_stars", lambda members, stars=M._stars: stars(members).limit(0))
    monkeypatch.setattr(M, "_crowded", lambda *a: (calls.append(a), crowded(*a))[1])
    docs = spark.createDataFrame(rows + [(None, "a b c"), (3, rows[3][1])], "doc_id long, text string")
    got = M.near_duplicates(docs).collect()
    want = brute.near_duplicates(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert len(calls) == 1 and len(got) == len(rows) + 2
    assert 20 < sum(d != c for d, (_, c) in want.items()) < 100


def test_work_of_a_crowd_leaves_the_passage_out(spark):
    rows = texts(random.Random(6), 1200, copies=0, known=100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    crowd = docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("group"))
    prefixes = M._prefixes(docs, crowd, 2, 80, len(rows))
    assert 1 < prefixes.groupBy("node").count().agg(F.max("count")).first()[0] <= 6  # of 27
    met = sum(r["count"] * (r["count"] - 1) // 2 for r in prefixes.groupBy("v").count().collect())
    assert 0 < met < 1200 * 1199 // 2 // 20  # all pairs share the passage
