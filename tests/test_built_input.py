"""Input files that the ingest queries build: their size on disk and by file, and that nothing is lost in them."""

import gzip
import json
import os
from collections import Counter
from glob import glob

import pytest
from pyspark.sql import functions as F

from feedlens.plans import ingest_catalog as I

ROWS = 2500


@pytest.fixture()
def tables(spark, tmpdir_run):
    """A folder of the four tables that signals come from; every line item finds its part and supplier."""
    d = f"{tmpdir_run}/tables"
    i = F.col("id")
    spark.range(25).select(i.alias("n_nationkey"), F.concat(F.lit("N"), "id").alias("n_name")).write.parquet(f"{d}/nation.parquet")
    spark.range(40).select(i.alias("s_suppkey"), F.concat(F.lit("S"), "id").alias("s_name"),
                           (i % 25).alias("s_nationkey")).write.parquet(f"{d}/supplier.parquet")
    spark.range(90).select(i.alias("p_partkey"), F.concat(F.lit("P"), i % 7).alias("p_type")).write.parquet(f"{d}/part.parquet")
    spark.range(ROWS).select(
        i.alias("l_orderkey"), (i % 90).alias("l_partkey"), (i % 40).alias("l_suppkey"), (i % 7 + 1).cast("int").alias("l_linenumber"),
        (i % 50 + 1).cast("double").alias("l_quantity"),
        F.expr("timestamp_ntz'1995-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 900 as int))").alias("l_shipdate"),
    ).repartition(3).write.parquet(f"{d}/lineitem.parquet")
    return d


def texts(path):
    found = sorted(glob(f"{path.removeprefix('file:')}/part-*"))
    assert found and all(f.endswith(".gz") for f in found)
    return [gzip.open(f, "rt", encoding="utf-8").read() for f in found]


@pytest.mark.parametrize("heads", [[(0, '[{"source": "none"},')], [(0, "["), (1, '{"a": },'), (2, '{"b": "torn,')]])
def test_arrays_are_whole_files_of_bounded_rows(spark, tables, tmpdir_run, monkeypatch, heads):
    monkeypatch.setattr(I, "_FILE_ROWS", 200)
    path = os.path.join(tmpdir_run, "arrays.json")
    I._put_arrays(spark, tables, path, heads)
    orders, whole = Counter(), 0
    for text in texts(path):
        lines = text.splitlines()
        assert lines[0] == heads[0][1] and lines[-2:] == ['{"source": "none"}', "]"]
        assert [lines.count(x) for _, x in heads] == [1] * len(heads)
        records = [json.loads(x[:-1]) for x in lines if x.endswith("},") and x not in dict(map(reversed, heads))]
        whole += len(records) == 200
        assert 0 < len(records) <= 200 and len(lines) == len(records) + len(heads) + 2
        if len(heads) == 1:
            assert len(json.loads(text)) == len(records) + 2
        orders.update((r["company"], r["date"], r["rating"], r["sentiment_score"]) for r in records)
    assert sum(orders.values()) == ROWS and whole > 5
    sig = I.signals_from_tables(spark, tables)
    assert orders == Counter((r.company, str(r.date), r.rating, r.sentiment_score) for r in sig.collect())


def test_only_blocks_with_a_torn_line_are_shuffled(spark, tables, tmpdir_run, monkeypatch):
    paths, blocks = [], []
    put, put_blocks = I._put_lines, I._put_blocks
    monkeypatch.setattr(I, "_BLOCK_BYTES", 4000)
    monkeypatch.setattr(I, "_put_lines", lambda values, path, *a: (paths.append(path), put(values, path, *a))[1])
    monkeypatch.setattr(I, "_put_blocks", lambda lines, path: (blocks.append(lines), put_blocks(lines, path))[1])
    out = I.q_json_first_line(spark, tables)
    assert 16 < blocks[0].count() < ROWS // 2  # the others are written where they are
    lines = [x for text in texts(paths[0]) for x in text.splitlines()]
    assert len(lines) == ROWS + 16 and sum(not x.endswith("}") for x in lines) == 16
    assert any(text.startswith('{"date": "2020-01-01", "source": "CF\n') for text in texts(paths[0]))
    sig = I.signals_from_tables(spark, tables).select(
        "date", "company", F.coalesce("sentiment_score", F.lit(0.0)).alias("s"), F.coalesce("rating", F.lit(0.0)).alias("r"))
    got = out.select("date", "company", F.col("sentiment_score").alias("s"), F.col("rating").alias("r"))
    assert out.select("torn").distinct().collect() == [(16,)] and out.count() == ROWS
    assert got.exceptAll(sig).isEmpty() and sig.exceptAll(got).isEmpty()


def test_a_csv_in_compressed_parts_is_discovered_and_read(spark, tables, tmpdir_run):
    staging, df = os.path.join(tmpdir_run, "staging"), I.signals_from_tables(spark, tables).drop("dataset_id")
    I.put_parts(df, f"{staging}/a.csv", maxRecordsPerFile=300, **I._GZIP)
    I.put_parts(df, f"{staging}/b.csv")
    with gzip.open(f"{staging}/c.csv.gz", "wt") as out:  # no part of a file: not a .csv
        out.write("date,source\n2020-01-01,x\n")
    assert len(glob(f"{staging}/a.csv/part-*.csv.gz")) >= ROWS // 300
    store = I.SignalStore(spark, os.path.join(tmpdir_run, "store"))
    scan = {r["name"]: (r["ext"], r["size_bytes"]) for r in store.scan_available(staging).collect()}
    assert set(scan) == {"a.csv", "b.csv"} and scan["a.csv"][0] == ".csv" and 0 < scan["a.csv"][1] < scan["b.csv"][1] // 3
    for name in scan:
        store.ingest(f"{staging}/{name}")
    assert [r["row_count"] for r in store.registry().collect()] == [ROWS, ROWS]
    rows = [store.signals().where(F.col("dataset_id") == i).drop("dataset_id") for i in (1, 2)]
    assert rows[0].exceptAll(rows[1]).isEmpty()
