"""The pipeline's stages against plain Python, each on its own input, and run() as a whole."""

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline as pipeline
from feedlens.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"
STAGES = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def bench(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def deduped_lines(rows):
    return [(d, t) for d, _, _, t in brute.line_dedup(rows)]


def without_copies(rows):
    found = brute.near_duplicates(rows, 5)
    return [(d, t) for d, t in rows if found[d][1] == d]


def clean(rows, items):
    return [(r[0], t) for r, (_, t) in zip(brute.contamination(rows, items), rows) if r[2] == 0]


def test_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "decontamination", "mixing"]


def test_stages_and_run(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity(documents, labels).where("predicted = 1").collect()}
    rows = [(d, t) for d, t in texts(documents) if d not in toxic]
    first = STAGES["toxicity"](spark, documents, SF)
    assert first.columns == documents.columns and texts(first) == rows

    second = STAGES["line_dedup"](spark, first, SF)
    rows = deduped_lines(rows)
    assert second.columns == documents.columns and texts(second) == rows
    assert second.where(F.length("text") != F.col("n_chars")).count() == 0

    third = STAGES["minhash_dedup"](spark, second, SF)
    rows = without_copies(rows)
    assert third.columns == documents.columns and texts(third) == rows

    fourth = STAGES["decontamination"](spark, third, SF)
    rows = clean(rows, bench(spark))
    assert fourth.columns == documents.columns and texts(fourth) == rows

    order = pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in order} <= {d for d, _ in rows}
    assert [r.mix_position for r in order] == sorted(r.mix_position for r in order)
    sizes, source = {}, {r.doc_id: r.source for r in fourth.collect()}
    for d, t in rows:
        sizes[source[d]] = sizes.get(source[d], 0) + len(brute.words(t))
    want, taken = brute.targets(sizes), dict.fromkeys(sizes, 0)
    for r in order:
        taken[r.source] += r.mix_words
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


@pytest.mark.parametrize("name", list(STAGES))
def test_awkward_rows(spark, documents, name):
    """Nulls in every column, empty texts, repeated rows, more columns, and no rows at all."""
    rows = [(1, "a b c", "en", "s", 5, "x", 1), (1, "a b c", "en", "s", 5, "x", 1), (2, None, None, None, None, None, None),
            (None, "z z z\nz", "de", None, 7, "y", 2), (3, "", "en", "s", 0, "x", 3), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "kept string, row long")
    for df in (docs, docs.limit(0)):
        out = STAGES[name](spark, df, SF)
        out.collect()
        if name != "mixing":
            assert out.columns == docs.columns
