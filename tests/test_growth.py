"""Reading and cleaning whose cost a row does not grow with the expressions over it; work that is dealt among tasks."""

import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from feedlens.functions.dates import lenient_date
from feedlens.functions.text import strip_ws
from feedlens.operators import clean, joins
from feedlens.sources import readers
from feedlens.sources.batch import load_files
from feedlens.sources.store import SignalStore
from feedlens.streaming.staged_import import import_staged


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as fh:
        fh.write(text)
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_date_filter_stays_above_the_reader(spark, tmpdir_run):
    path = put(tmpdir_run, "a.jsonl", json.dumps({" Date ": "05/04/2021", "source": " a "}) + "\n" + json.dumps({"date": "x"}) + "\n")
    df = clean.transform_and_clean(readers.read_json(spark, path))
    assert [(r.date, r.source) for r in df.collect()] == [(dt.date(2021, 4, 5), "a")]
    assert plan(df).count("from_json(") == 1
    assert not any("gettimestamp" in line or "from_json" in line for line in plan(df).splitlines() if " Filter " in line)


def test_shapes_lose_no_value(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("0123456789+-./ eEinfaNd\t\x00\u00a0") for _ in range(rng.randint(0, 6))) for _ in range(3000)]
    dates = [f"{rng.randint(0, 40):02d}{c}{rng.randint(0, 13):02d}{c}{rng.randint(0, 12000):04d}" for c in "-/" for _ in range(300)]
    dates += [f"{rng.randint(0, 12000):04d}{c}{rng.randint(0, 13):02d}{c}{rng.randint(0, 32):02d}" for c in "-/" for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in [*texts, *dates, "inf", "-Infinity", " NaN", "+12020/01/01", "a\u2028", None]], "v string")
    v = F.col("v")
    stripped = F.regexp_replace(v, r"(?U)^\s+|\s+$", "")
    iso = F.when(stripped.rlike(r"^[+-]?\d{4,}-\d{1,2}-\d{1,2}"), stripped.try_cast("date"))
    plain = {
        "int": (clean._lenient_int(df, "v"), F.coalesce(v.try_cast("int"), v.try_cast("double").try_cast("int"))),
        "double": (clean._lenient_double(df, "v"), v.try_cast("double")),
        "text": (strip_ws(v), stripped),
        "date": (lenient_date(v, df.schema["v"].dataType),
                 F.coalesce(iso, *[F.try_to_date(stripped, f) for f in ("yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy")])),
    }
    for name, (got, want) in plain.items():
        assert df.where(~got.eqNullSafe(want)).count() == 0, name
        assert df.where(want.isNotNull()).count() > 10, name


def ends_quoted(line, state):
    """Character by character: outside (0), inside (1), behind a quote that may have closed (2)."""
    begins = state == 0
    for ch in line:
        if ch == '"':
            state = {0: 1 if begins else 0, 1: 2, 2: 1}[state]
            begins = False
        else:
            state = 0 if state == 2 else state
            begins = state == 0 and ch == ","
    return state == 1


def test_quotes_of_lines(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice('"",,ax') for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    lines += ['"' + '""' * 50_000, '"a' * 50_000, '"a",' * 50_000 + '"x']  # no recursion by the line's length
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = df.select(*[readers._ends_quoted(F.col("value"), bool(s)) for s in (0, 1)]).collect()
    for line, r in zip(lines, got):
        assert [r[0], r[1]] == [ends_quoted(line, 0), ends_quoted(line, 1)], line[:50]


def test_files_no_larger_than_a_split_are_not_shuffled(spark, tmpdir_run):
    path = put(tmpdir_run, "a.csv", 'date,text\n2020-01-01,"a\nb ""c"""\n2020-01-02,d\n')
    df = readers.read_csv(spark, path)
    assert "Exchange" not in plan(df) and "Window" not in plan(df)
    assert sorted(r.text for r in df.collect()) == ['a\nb "c"', "d"]


def test_compacted_files_are_cut_by_rows(spark, tmpdir_run, monkeypatch):
    monkeypatch.setattr(SignalStore, "FILE_ROWS", 1000)
    store = SignalStore(spark, os.path.join(tmpdir_run, "store"))
    df = spark.range(4000).select(
        F.lit("2020-01-01").alias("date"), *[F.lit(None).cast("string").alias(c) for c in (
            "year", "month", "customer_action", "sentiment_score", "sentiment_label", "source", "company",
            "product_service", "country", "rating")], F.concat(F.lit("t"), "id").alias("text"))
    store.append_table(df, "a")
    store.append_table(df, "b")
    assert store.compact() == 2
    per_file = spark.read.parquet(store.compacted_path).groupBy(F.input_file_name()).count().collect()
    assert len(per_file) > 4 and max(r[1] for r in per_file) < 2500
    assert sorted(r[1] for r in store.signals().groupBy("dataset_id").count().collect()) == [4000, 4000]


def folder(spark, path, n):
    """A CSV file in several parts, one of them without rows."""
    df = spark.range(n).select(F.lit("2020-01-01").alias("date"), F.concat(F.lit("s"), "id").alias("source"))
    df.repartition(3).union(df.limit(0)).write.option("header", True).csv(path)


def test_a_folder_is_one_staged_file(spark, tmpdir_run):
    staging = os.path.join(tmpdir_run, "staging")
    folder(spark, f"{staging}/a [1].csv", 10)
    folder(spark, f"{staging}/nested/B.CSV", 20)
    folder(spark, f"{staging}/none.csv", 0)
    put(staging, "c.csv", "date,source\n2020-01-01,x\n")
    store = SignalStore(spark, os.path.join(tmpdir_run, "store"))
    names = {r["name"]: r["imported"] for r in store.pending(staging).collect()}
    assert {"a [1].csv", "B.CSV", "c.csv"} <= set(names) and not any(n.startswith("part-") for n in names)
    for _ in range(2):  # the second run finds nothing new
        import_staged(spark, store, staging, checkpoint=os.path.join(tmpdir_run, f"ckpt{_}"))
        rows = store.signals().groupBy(F.col("dataset_id").alias("id")).count()
        assert {(r["name"], r["row_count"], r["count"]) for r in store.registry().join(rows, "id").collect()} == {
            ("a [1]", 10, 10), ("B", 20, 20), ("c", 1, 1)}
    assert store.registry().count() == 3


def test_a_bad_part_stops_its_file_only(spark, tmpdir_run):
    put(tmpdir_run, "in/a.csv/part-0.csv", "date,source\n2020-01-01,x\n")
    put(tmpdir_run, "in/a.csv/part-1.csv", "date,Source, source\n2020-01-01,x,y\n")
    put(tmpdir_run, "in/b.csv", "date,source\n2020-01-01,x\n")
    store = SignalStore(spark, os.path.join(tmpdir_run, "store"))
    a, b = (os.path.join(tmpdir_run, "in", n) for n in ("a.csv", "b.csv"))
    done = load_files(store, dict(zip((a, b), store.allocate(2))))
    assert done.rows == {b: 1} and set(done.reasons) == {a}


def test_broadcasts_go_by_the_rows_in_memory(spark, tmpdir_run):
    """Repeated texts take a hundredth of their bytes in a file; a join of small tables is not the product of their sizes."""
    tables = {"part": spark.range(300_000).select("id", F.lit("PROMO BURNISHED COPPER").alias("v")),
              "supplier": spark.range(2000).withColumn("nation", F.col("id") % 25), "nation": spark.range(25).toDF("nation")}
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmpdir_run}/{name}")
    part, supplier, nation = (spark.read.parquet(f"{tmpdir_run}/{name}") for name in tables)
    limit = 16 << 20
    assert joins.estimated_bytes(part) < limit < joins.held_bytes(part)
    both = supplier.join(F.broadcast(nation), "nation")
    small = joins.held_bytes(both)
    assert 2000 * 16 < small < joins.estimated_bytes(both)
    fact = spark.range(1000).toDF("k")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        far, near = (fact.join(joins.broadcast_if_small(d, at), F.col("k") == F.col("id")) for d, at in ((part, limit), (both, small)))
        assert "BroadcastHashJoin" not in plan(far) and "SortMergeJoin" in plan(far)
        assert "SortMergeJoin" not in plan(near)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert far.count() == near.count() == 1000
