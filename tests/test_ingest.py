"""Ingest round trips (S1-S9, C1-C7), registry (R1-R6), discovery (S8) and X1."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from feedlens.operators.clean import transform_and_clean
from feedlens.sources import readers
from feedlens.sources.store import SignalStore
from feedlens.streaming.staged_import import import_staged

DIRTY_CSV = (
    ' Date ,SOURCE,company,product_service,sentiment_score,sentiment_label,customer_action,'
    'text,year,month,rating,extra\n'
    '2020-01-05, Reddit ,\tAcme ,Card,0.5,positive,advocating,"multi\nline ""quoted""",'
    '2019.0,,4.5,x\n'
    '2020/02/07,CFPB,Beta,Loan,abc,negative,complaining,plain,2019,,,y\n'
    '07-03-2020,AppStore,Gamma,App,NaN,negative,venting,,,,,z\n'
    'not a date,Reddit,Acme,Card,,neutral,discussing,t,,,,w\n'
    '2020-04-09 10:00:00,GooglePlay,Acme,Card,,neutral,discussing,t,,,2,w\n'
)

ROWS = [
    {"date": "2021-03-05", "source": "CFPB", "company": "A", "sentiment_score": 0.25,
     "customer_action": "complaining", "sentiment_label": "negative", "text": "x", "rating": 3.0},
    {"date": "05/04/2021", "source": "Reddit", "company": " B ", "sentiment_score": None,
     "customer_action": "venting", "sentiment_label": "negative", "text": None, "rating": None},
]


def _write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


def test_dirty_csv_cleaning(spark, tmpdir_run):
    p = _write(os.path.join(tmpdir_run, "dirty.csv"), DIRTY_CSV)
    raw = readers.route_to_reader(spark, p)
    rows = transform_and_clean(raw).orderBy("date").collect()
    assert len(rows) == 4  # the unparsable date is dropped (C7)
    r0 = rows[0]
    assert r0.date == dt.date(2020, 1, 5)
    assert r0.source == "Reddit" and r0.company == "Acme"  # C5: tab and no-break space stripped
    assert r0.year == 2019 and r0.month == 1  # an explicit '2019.0' wins over the date
    assert r0.text == 'multi\nline "quoted"'
    assert r0.country == "Unknown" and r0.rating == 4.5
    r1 = rows[1]
    assert r1.date == dt.date(2020, 2, 7) and r1.year == 2019  # explicit year wins (C6)
    assert r1.sentiment_score == 0.0 and r1.rating == 0.0  # 'abc' / empty -> 0.0 fill
    r2 = rows[2]
    assert r2.date == dt.date(2020, 3, 7)  # dd-MM-yyyy
    assert r2.sentiment_score is None  # NaN stored as NULL after the fill
    assert r2.text == ""
    assert rows[3].date == dt.date(2020, 4, 9)  # timestamp string
    assert raw.columns[0] == " Date "
    assert transform_and_clean(raw).columns == [
        "date", "year", "month", "customer_action", "sentiment_score", "sentiment_label",
        "source", "company", "product_service", "text", "country", "rating"]


def test_json_array_and_lines_agree(spark, tmpdir_run):
    arr = _write(os.path.join(tmpdir_run, "a.json"), json.dumps(ROWS, indent=2))
    lines = _write(os.path.join(tmpdir_run, "b.jsonl"), "\n".join(json.dumps(r) for r in ROWS))
    a = transform_and_clean(readers.route_to_reader(spark, arr))
    b = transform_and_clean(readers.route_to_reader(spark, lines))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    got = {r.company: r for r in a.collect()}
    assert got["B"].date == dt.date(2021, 4, 5) and got["B"].text == ""


def test_unknown_extension(spark, tmpdir_run):
    with pytest.raises(ValueError):
        readers.route_to_reader(spark, os.path.join(tmpdir_run, "x.xlsx"))


def test_store_roundtrip_registry_and_delete(spark, tmpdir_run):
    store = SignalStore(spark, os.path.join(tmpdir_run, "store"))
    assert store.signals().count() == 0 and store.datasets().count() == 0
    csv = _write(os.path.join(tmpdir_run, "first.csv"), DIRTY_CSV)
    id1 = store.ingest(csv)
    pq = os.path.join(tmpdir_run, "second.parquet")
    spark.createDataFrame([(r["date"], r["source"], r["company"]) for r in ROWS],
                          "date string, source string, company string").write.parquet(pq)
    id2 = store.ingest(pq, name="named")
    assert (id1, id2) == (1, 2)
    reg = {r.id: r for r in store.datasets().collect()}
    assert reg[1].name == "first" and reg[1].row_count == 4
    assert reg[2].name == "named" and reg[2].row_count == 2
    assert [r.id for r in store.datasets().collect()][0] == 2  # newest first
    s = store.summary().first()
    assert (s.datasets, s.rows) == (2, 6)
    # accumulative: loading the same file again adds a dataset, never dedups
    id3 = store.ingest(csv)
    assert id3 == 3 and store.signals().count() == 10
    store.delete(id3)
    assert store.signals().count() == 6 and store.datasets().count() == 2
    # ids are never reused
    assert store.ingest(csv) == 4
    store.delete_all()
    assert store.signals().count() == 0 and store.datasets().count() == 0
    assert store.ingest(csv) == 5


def test_empty_file_rejected_but_all_dropped_registers_zero(spark, tmpdir_run):
    store = SignalStore(spark, os.path.join(tmpdir_run, "store"))
    empty = _write(os.path.join(tmpdir_run, "empty.csv"), "date,source\n")
    with pytest.raises(ValueError):
        store.ingest(empty)
    junk = _write(os.path.join(tmpdir_run, "junk.csv"), "date,source\nnope,Reddit\n")
    i = store.ingest(junk)
    assert store.datasets().where(F.col("id") == i).first().row_count == 0


def test_staged_import_is_replayed_without_doubling(spark, tmpdir_run, monkeypatch):
    """A crash between the data write and the registry write, then the same batch again."""
    staging, ckpt = os.path.join(tmpdir_run, "staging"), os.path.join(tmpdir_run, "ckpt")
    os.makedirs(staging)
    _write(os.path.join(staging, "s.csv"), "date,source\n2020-01-01,Reddit\n2020-01-02,CFPB\n")
    store = SignalStore(spark, os.path.join(tmpdir_run, "store"))

    def crash(self, rows):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(SignalStore, "register", crash)
        with pytest.raises(Exception):
            import_staged(spark, store, staging, checkpoint=ckpt)
    assert store.signals().count() == 0  # written, not published
    assert store.signals(include_unpublished=True).count() == 2
    import_staged(spark, store, staging, checkpoint=ckpt)
    assert store.signals(include_unpublished=True).count() == store.signals().count() == 2
    assert [(r.id, r.row_count) for r in store.datasets().collect()] == [(1, 2)]
    assert store.reconcile().count() == 0


def test_names_and_rejections(spark, tmpdir_run):
    staging = os.path.join(tmpdir_run, "staging")
    os.makedirs(staging)
    good = "date,source\n2020-01-01,Reddit\n"
    for name, text in {"Mixed.Csv": good, "a[1].csv": good, "b{x}.csv": good, "collide.csv": "date,Source, source\n2020-01-01,a,b\n",
                       "torn.parquet": "PAR1", "empty.csv": "date\n", "__hidden.csv": good,
                       "half.json": '{"date": "2020-01-01"}\n{"date"\n'}.items():
        _write(os.path.join(staging, name), text)
    store = SignalStore(spark, os.path.join(tmpdir_run, "store"))
    ckpt = os.path.join(tmpdir_run, "ckpt")
    import_staged(spark, store, staging, checkpoint=ckpt)
    assert sorted(r.name for r in store.datasets().collect()) == ["Mixed", "a[1]", "b{x}", "half"]
    reasons = {r.source_path.rsplit("/", 1)[-1]: r.reason for r in store.rejected().collect()}
    assert sorted(reasons) == ["collide.csv", "empty.csv", "half.json", "torn.parquet"]
    assert reasons["half.json"] == "1 malformed records" and "collide" in reasons["collide.csv"]
    import_staged(spark, store, staging, checkpoint=ckpt)
    assert store.rejected().count() == 4 and store.datasets().count() == 4


def test_json_documents_lose_no_record(spark, tmpdir_run):
    records = [{"date": f"2020-01-{d:02d}", "source": "CFPB", " Company ": {"a": 1}} for d in range(1, 10)]
    one = ",\n".join(json.dumps(r) for r in records)
    for i, text in enumerate((f"[{one}]", f"[{one}\n]", f"\n \n[\n{one}\n]\n", json.dumps(records),
                              json.dumps(records, indent=1), "\n\n".join(json.dumps(r) for r in records))):
        df = transform_and_clean(readers.read_json(spark, _write(os.path.join(tmpdir_run, f"{i}.json"), text)))
        assert df.count() == 9, text[:40]
        assert {r.company for r in df.collect()} == {'{"a":1}'}
    single = _write(os.path.join(tmpdir_run, "single.json"), json.dumps(records[0], indent=2))
    assert transform_and_clean(readers.read_json(spark, single)).count() == 1
    assert readers.read_json(spark, _write(os.path.join(tmpdir_run, "none.json"), " \n")).count() == 0


def test_large_csv_is_read_in_splits(spark, tmpdir_run):
    path = _write(os.path.join(tmpdir_run, "large.csv"), "date,source,text\n" + "2020-01-01,CFPB,plain\n" * 200_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert readers.read_csv(spark, path).rdd.getNumPartitions() > 1
        quoted = _write(os.path.join(tmpdir_run, "quoted.csv"), 'date,text\n2020-01-01,"a\nb"\n')
        assert readers.has_quoted_newlines(spark, quoted)
        assert [r.text for r in readers.read_csv(spark, quoted).collect()] == ["a\nb"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text", ["2020", "2020-05", "5", "12:30"])
def test_partial_dates_are_no_dates(spark, text):
    df = spark.createDataFrame([(text, "CFPB")], "date string, source string")
    assert transform_and_clean(df).count() == 0


def test_append_table_rejects_values_the_schema_cannot_hold(spark, tmpdir_run):
    from feedlens.plans.testbed import signals_from_tables

    store = SignalStore(spark, os.path.join(tmpdir_run, "store"))
    sig = signals_from_tables(spark, "/root/testdata/sf0.001").drop("dataset_id")
    with pytest.raises(ValueError, match="rating"):
        store.append_table(sig.withColumn("rating", F.lit("many")), "x")
    assert store.datasets().count() == 0


def test_a_cluster_needs_a_shared_checkpoint_folder(monkeypatch):
    from feedlens import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_append_table_requires_all_columns(spark, tmpdir_run):
    store = SignalStore(spark, os.path.join(tmpdir_run, "store"))
    with pytest.raises(ValueError):
        store.append_table(spark.createDataFrame([("2020-01-01",)], "date string"), "x")
    from feedlens.plans.testbed import signals_from_tables
    sig = signals_from_tables(spark, "/root/testdata/sf0.001").drop("dataset_id")
    i = store.append_table(sig, "testbed")
    n = sig.count()
    assert store.datasets().first().row_count == n
    # pre-shaped rows keep their NULL scores (no cleaning)
    assert store.signals().where(F.col("sentiment_score").isNull()).count() == \
        sig.where(F.col("sentiment_score").isNull()).count() > 0
    assert i == 1


def test_reconcile_orphans_and_nulls_idempotent(spark, tmpdir_run):
    root = os.path.join(tmpdir_run, "store")
    store = SignalStore(spark, root)
    csv = _write(os.path.join(tmpdir_run, "one.csv"), DIRTY_CSV)
    store.ingest(csv)
    # an orphan partition (no registry row) and rows with a NULL dataset id
    clean = transform_and_clean(readers.route_to_reader(spark, csv))
    clean.select(F.lit(7).cast("bigint").alias("dataset_id"), "*") \
        .write.mode("append").partitionBy("dataset_id").parquet(store.signals_path)
    clean.select(F.lit(None).cast("bigint").alias("dataset_id"), "*") \
        .write.mode("append").partitionBy("dataset_id").parquet(store.signals_path)
    added = store.reconcile().orderBy("id").collect()
    assert [(r.name, r.row_count) for r in added] == [
        ("Datos sin registrar (recuperado)", 4), ("Dataset 7 (recuperado)", 4)]
    assert store.signals().where(F.col("dataset_id").isNull()).count() == 0
    assert store.reconcile().count() == 0  # idempotent
    assert store.datasets().count() == 3
    assert store.ingest(csv) == 8  # one above every id seen (recovered=2, orphan=7)


def test_pick_best_file_and_scan(spark, tmpdir_run):
    root = os.path.join(tmpdir_run, "staging")
    os.makedirs(os.path.join(root, "nested"))
    for name in ["b.json", "a.csv", ".hidden.csv", "__x.csv", "~y.csv", "c.CSV",
                 "nested/z.parquet", "nested/d.csv", "notes.txt"]:
        _write(os.path.join(root, name), "date,source\n2020-01-01,Reddit\n")
    best = readers.pick_best_file(readers.list_files(spark, root), root).first()
    assert best["name"] == "a.csv"  # root level before nested; csv before json
    store = SignalStore(spark, os.path.join(tmpdir_run, "store"))
    store.ingest(os.path.join(root, "a.csv"))
    scan = store.scan_available(root).collect()
    assert [r.name for r in scan] == ["a.csv", "c.CSV", "d.csv"]
    assert [r.imported for r in scan] == [True, False, False]
    assert [r.name for r in store.pending(root).collect()] == ["c.CSV", "d.csv"]
    # a folder ingests its best file
    i = store.ingest(root)
    assert store.datasets().where(F.col("id") == i).first().name == "a"


def test_streaming_import_loads_each_file_once(spark, tmpdir_run):
    staging = os.path.join(tmpdir_run, "staging")
    os.makedirs(staging)
    _write(os.path.join(staging, "s1.csv"), DIRTY_CSV)
    _write(os.path.join(staging, "s2.jsonl"), "\n".join(json.dumps(r) for r in ROWS))
    store = SignalStore(spark, os.path.join(tmpdir_run, "store"))
    ckpt = os.path.join(tmpdir_run, "ckpt")
    import_staged(spark, store, staging, checkpoint=ckpt)
    names = sorted(r.name for r in store.datasets().collect())
    assert names == ["s1", "s2"]
    assert store.signals().count() == 6
    # a second run finds nothing new
    import_staged(spark, store, staging, checkpoint=ckpt)
    assert store.datasets().count() == 2
    # stream ingest equals batch ingest
    batch = SignalStore(spark, os.path.join(tmpdir_run, "batch"))
    batch.ingest(os.path.join(staging, "s1.csv"))
    batch.ingest(os.path.join(staging, "s2.jsonl"))
    cols = [c for c in store.signals().columns if c != "dataset_id"]
    assert sorted(map(tuple, store.signals().select(cols).collect()), key=str) == \
        sorted(map(tuple, batch.signals().select(cols).collect()), key=str)
