"""Records that do not parse, records that span lines, crashes, deletion under readers, compaction, many files."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from feedlens.operators.clean import transform_and_clean
from feedlens.sources import readers
from feedlens.sources.batch import load_files
from feedlens.sources.store import SignalStore
from feedlens.streaming.staged_import import import_staged

CSV = "date,source\n2020-01-01,Reddit\n2020-01-02,CFPB\n"


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as fh:
        fh.write(text)
    return path


@pytest.fixture()
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("300", "0")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


# -- JSON: each record by itself ---------------------------------------------------

RECORDS = [{"date": f"2020-01-{d:02d}", "source": f"s{d}", "text": 'a "}, {" b', "tags": [{"a": 1}, {"b": 2}]}
           for d in range(1, 6)]
ONE = [json.dumps(r) for r in RECORDS]
TORN = '{"date": "2020-01-09", "source": "to'
BROKEN = '{"date": "2020-01-09", "source": , "tags": [{"a": 1}, {"b": 2}]}'


@pytest.mark.parametrize("text,good,lost", [
    (TORN + "\n" + "\n".join(ONE), 5, 1),
    ("\n".join([*ONE[:2], TORN, *ONE[2:], TORN]), 5, 2),
    ("[" + ",\n".join([*ONE[:2], BROKEN, *ONE[2:]]) + "]", 5, 1),
    ("[\n" + ",\n".join([BROKEN, *ONE]) + "\n]\n", 5, 1),
    ("[" + ", ".join([*ONE, BROKEN]) + "]", 5, 1),
    ("[" + ", ".join([*ONE[:4], BROKEN, ONE[4]]) + "]", 5, 1),
    ("[" + ", ".join([ONE[0], TORN, *ONE[1:]]) + "]", 5, 1),
    (json.dumps(RECORDS, indent=2).replace('"s3"', ""), 4, 1),
    (json.dumps(RECORDS, indent=2)[:-30], 4, 1),
    ("\n".join(json.dumps(r, indent=1) for r in RECORDS), 5, 0),
    (ONE[0] + ONE[1] + "\n" + ONE[2] + "," + ONE[3] + "\n" + ONE[4], 5, 0),
    ("\n".join([*ONE, '{"date": "2020-01-09", "Date ": "2020-01-09"}']), 5, 1),
    ("\n".join([*ONE, "3", '"x"']), 5, 2),
    ("[]", 0, 0), ("", 0, 0), ("[\n]\n", 0, 0), ("nothing", 0, 1)])
def test_json_loses_only_the_broken_record(spark, tmpdir_run, text, good, lost):
    raw = readers.read_json(spark, put(tmpdir_run, "a.json", text))
    assert raw.where(F.col(readers.MALFORMED).isNotNull()).count() == lost
    rows = transform_and_clean(raw).orderBy("date").collect()
    assert [r.source for r in rows] == [f"s{d}" for d in range(1, 6) if good == 5 or (d != 3 if "s3" not in text else d != 5)][:good]
    assert all(r.text == 'a "}, {" b' for r in rows)


def test_json_lines_are_read_in_splits_with_their_file(spark, tmpdir_run, small_splits):
    a = put(tmpdir_run, "a [1].jsonl", "\n".join(ONE * 10) + "\n" + TORN)
    b = put(tmpdir_run, "b.json", json.dumps(RECORDS, indent=2))
    rows = readers.read_json(spark, [a, b], keep_path=True)
    assert rows.rdd.getNumPartitions() > 3
    got = {r[0]: (r[1], r[2]) for r in rows.groupBy(readers.SOURCE_FILE).agg(
        F.count("date"), F.count(readers.MALFORMED)).collect()}
    assert got == {readers.file_uri(spark, "file:" + a): (50, 1), readers.file_uri(spark, "file:" + b): (5, 0)}


def test_a_record_whose_names_collide_costs_no_other(spark, tmpdir_run):
    store = SignalStore(spark, os.path.join(tmpdir_run, "store"))
    store.ingest(put(tmpdir_run, "a.jsonl", "\n".join([*ONE, '{"date": "2020-01-09", "DATE": "2020-01-08"}'])))
    assert store.signals().count() == 5 and store.rejected().first().reason == "1 malformed records"


# -- CSV: records that span lines ----------------------------------------------------

def some_csv(rng):
    eol = rng.choice(["\n", "\r\n"])

    def cell():
        if rng.random() < 0.3:
            return rng.choice(["a", "bc", "", '5" disk', "x y"])
        return '"' + "".join(rng.choice(["a", "b", "\n", ",", '""', "x", "\n\n", "\r\n"]) for _ in range(rng.randint(0, 12))) + '"'

    text = "h1, H2 ,h3" + eol
    for _ in range(rng.randint(1, 120)):
        text += ",".join(cell() for _ in range(rng.choice([3, 3, 3, 2, 4]))) + eol * rng.choice([1, 1, 1, 2])
    return text[:-len(eol)] if rng.random() < 0.3 else text


def test_spanning_records_equal_those_of_one_task(spark, tmpdir_run, small_splits):
    rng = random.Random(5)
    texts = [some_csv(rng) for _ in range(6)]
    texts.append("h1, H2 ,h3\n" + '1,"' + "x\n" * 400 + '",2\n' + "p,q,r\n" * 50)  # one record over several splits
    for i, text in enumerate(texts):
        path = put(tmpdir_run, f"{i}.csv", text)
        assert readers.has_quoted_newlines(spark, path)
        whole = (spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path))
        got = readers.read_csv(spark, path)
        assert got.columns == whole.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
        lines = readers._with_place(spark.read.text(path))
        assert lines.rdd.getNumPartitions() > 1


def test_stray_quotes_do_not_span_lines(spark, tmpdir_run):
    path = put(tmpdir_run, "a.csv", 'date,text\n2020-01-01,5" disk\n2020-01-02,plain\n2020-01-03,"x ""y"""\n')
    assert not readers.has_quoted_newlines(spark, path)
    assert [r.text for r in readers.read_csv(spark, path).orderBy("date").collect()] == ['5" disk', "plain", 'x "y"']


def test_a_header_that_spans_lines(spark, tmpdir_run):
    path = put(tmpdir_run, "a.csv", 'date,"te\nxt"\n2020-01-01,"a\nb"\n')
    df = readers.read_csv(spark, path)
    assert df.columns == ["date", "te\nxt"] and df.first()[1] == "a\nb"


# -- identity --------------------------------------------------------------------------

def crash(spark, tmpdir_run, monkeypatch, staging, store):
    def lost(self, rows):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(SignalStore, "register", lost)
        with pytest.raises(Exception):
            import_staged(spark, store, staging, checkpoint=os.path.join(tmpdir_run, "ckpt"))


def test_reconcile_before_the_replay(spark, tmpdir_run, monkeypatch):
    staging, store = os.path.join(tmpdir_run, "staging"), SignalStore(spark, os.path.join(tmpdir_run, "store"))
    put(staging, "a.csv", CSV)
    crash(spark, tmpdir_run, monkeypatch, staging, store)
    added = store.reconcile().collect()
    assert [(r.id, r.name, r.row_count) for r in added] == [(1, "a", 2)] and added[0].source_mtime is not None
    import_staged(spark, store, staging, checkpoint=os.path.join(tmpdir_run, "ckpt"))
    assert [(r.id, r.name) for r in store.datasets().collect()] == [(1, "a")]
    assert tuple(store.summary().first()) == (1, 2) and store.signals().count() == 2
    assert store.reconcile().count() == 0


def test_lost_sequence_and_second_registration(spark, tmpdir_run, monkeypatch):
    staging, store = os.path.join(tmpdir_run, "staging"), SignalStore(spark, os.path.join(tmpdir_run, "store"))
    put(staging, "a.csv", CSV)
    crash(spark, tmpdir_run, monkeypatch, staging, store)
    for text in (None, "", "not a number\n", "0\n"):
        if text is None:
            os.remove(store.sequence_path)
        else:
            put(store.root, "sequence", text)
        assert store.allocate(2) == [x + 2 * [None, "", "not a number\n", "0\n"].index(text) for x in (2, 3)]
    import_staged(spark, store, staging, checkpoint=os.path.join(tmpdir_run, "ckpt"))
    assert [(r.id, r.name) for r in store.datasets().collect()] == [(1, "a")]
    assert store.register([(1, "other", 9, None, None), (2, "new", 0, None, None)]) == [2]
    assert sorted((r.id, r.name) for r in store.datasets().collect()) == [(1, "a"), (2, "new")]


def test_a_deleted_file_may_be_imported_again_under_a_new_id(spark, tmpdir_run):
    staging, store = os.path.join(tmpdir_run, "staging"), SignalStore(spark, os.path.join(tmpdir_run, "store"))
    put(staging, "a.csv", CSV)
    import_staged(spark, store, staging, checkpoint=os.path.join(tmpdir_run, "c1"))
    store.delete(1)
    import_staged(spark, store, staging, checkpoint=os.path.join(tmpdir_run, "c2"))
    store.vacuum(older_than=0)
    assert [(r.id, r.row_count) for r in store.datasets().collect()] == [(2, 2)] and store.signals().count() == 2


def test_append_reads_its_input_once(spark, tmpdir_run):
    from feedlens.plans.testbed import signals_from_tables

    store = SignalStore(spark, os.path.join(tmpdir_run, "store"))
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    sig = signals_from_tables(spark, "/root/testdata/sf0.001").drop("dataset_id")
    n = sig.count()
    store.append_table(sig.mapInArrow(count, sig.schema), "once")
    assert read.value == n and store.datasets().first().row_count == n
    for bad in (sig.withColumn("rating", F.lit("many")), sig.limit(0)):
        with pytest.raises(ValueError):
            store.append_table(bad, "x")
    assert store.datasets().count() == 1 and store.reconcile().count() == 0


# -- deletion, compaction ----------------------------------------------------------------

def data_files(path):
    return [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_a_reader_outlives_a_delete(spark, tmpdir_run):
    store = SignalStore(spark, os.path.join(tmpdir_run, "store"))
    for i in range(3):
        store.ingest(put(tmpdir_run, f"{i}.csv", CSV))
    reader = store.signals()  # files are listed here
    rows = reader.repartition(4).toLocalIterator()
    next(rows)
    store.delete(2)
    assert store.signals().count() == 4 and store.datasets().count() == 2
    assert store.signals(include_unpublished=True).count() == 4
    assert len(list(rows)) == 5 and reader.count() == 6
    store.vacuum()  # too young to go
    assert reader.count() == 6 and store.reconcile().count() == 0
    store.vacuum(older_than=0)
    assert not os.path.exists(f"{store.signals_path}/dataset_id=2") and not os.listdir(store.deleted_path)
    assert store.reconcile().count() == 0 and store.signals().count() == 4
    store.delete_all()
    assert store.signals().count() == 0 and store.reconcile().count() == 0
    store.vacuum(older_than=0)
    assert not data_files(store.signals_path) and store.ingest(os.path.join(tmpdir_run, "1.csv")) == 4


def test_compaction(spark, tmpdir_run):
    store = SignalStore(spark, os.path.join(tmpdir_run, "store"))
    files = {put(tmpdir_run, f"in/{i}.csv", CSV + f"2020-02-01,s{i}\n" * i): i for i in range(1, 13)}
    ids = dict(zip(files, store.allocate(len(files))))
    done = load_files(store, ids)
    store.register([(ids[p], str(files[p]), done.rows[p], p, None) for p in files])
    before = sorted(map(str, store.signals().collect()))
    assert store.compact() == 12 and sorted(map(str, store.signals().collect())) == before
    assert store.compact() == 0
    store.vacuum(older_than=0)
    assert sum("/datasets/" not in f and "/moved/" not in f for f in store.signals().inputFiles()) == 1
    assert sorted(map(str, store.signals().collect())) == before
    # a filter on the dataset reaches the file's statistics
    plan = store.signals().where("dataset_id = 5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(dataset_id,5)" in plan
    store.delete(ids[next(iter(files))])
    assert store.signals().count() == len(before) - 3 and store.datasets().count() == 11
    store.vacuum(older_than=0)
    store.vacuum(older_than=0)
    left = spark.read.parquet(store.compacted_path)
    assert left.count() == len(before) - 3 and left.select("generation").distinct().count() == 1
    assert not os.listdir(store.deleted_path) and store.reconcile().count() == 0
    assert store.signals().count() == len(before) - 3
    store.ingest(next(iter(files)))
    store.ingest(next(iter(files)))
    assert store.compact() == 2 and store.signals().count() == len(before) + 3
    store.delete_all()
    store.vacuum(older_than=0)
    assert store.signals().count() == 0 and not data_files(store.compacted_path)


# -- many files ---------------------------------------------------------------------------

def jobs_of(spark, group, fn):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = fn()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_go_by_headers_not_by_files(spark, tmpdir_run):
    jobs = {}
    for n in (40, 120):  # beyond 32 files, a job lists them
        store, files = SignalStore(spark, os.path.join(tmpdir_run, f"store{n}")), []
        for i in range(n):
            lines = f"2020-01-01,Reddit,{i}\n" * (i % 3 + 1)
            files.append(put(tmpdir_run, f"{n}/a{i}.csv", "date,source,text\n" + lines))
            files.append(put(tmpdir_run, f"{n}/b {i}%.CSV", "text,date\n" + '"x\ny",2020-01-01\n'))
            files.append(put(tmpdir_run, f"{n}/c[{i}].jsonl", ONE[i % 5] + "\n" + TORN * (i % 2)))
        for i in range(2):
            spark.createDataFrame([("2020-01-01", i)], "date string, year int").coalesce(1).write.parquet(f"{tmpdir_run}/{n}/p{i}")
            files += [f"{tmpdir_run}/{n}/p{i}/{f}" for f in os.listdir(f"{tmpdir_run}/{n}/p{i}") if f.endswith(".parquet")]
        ids = dict(zip(files, store.allocate(len(files))))
        jobs[n], done = jobs_of(spark, f"load {n}", lambda: load_files(store, ids))
        assert len(done.rows) == len(files) and len(done.reasons) == n // 2
        for p in files:
            name = os.path.basename(p)
            assert done.rows[p] == (int(name[1:-4]) % 3 + 1 if name[0] == "a" else 1), name
        rows = {r[0]: r[1] for r in store.signals(include_unpublished=True).groupBy("dataset_id").count().collect()}
        assert rows == {ids[p]: done.rows[p] for p in files}
        texts = store.signals(include_unpublished=True).where(F.col("text") == "x\ny").count()
        assert texts == n
    assert abs(jobs[120] - jobs[40]) <= 3 and jobs[120] < 40  # adaptive plans differ by some


def test_bad_files_stop_no_other(spark, tmpdir_run):
    good = [put(tmpdir_run, f"{i}.csv", CSV) for i in range(3)]
    spark.createDataFrame([("2020-01-01", "x" * 5000)] * 50, "date string, text string").coalesce(1).write.option(
        "compression", "none").option("parquet.enable.dictionary", "false").parquet(f"{tmpdir_run}/pq")
    file = next(f"{tmpdir_run}/pq/{f}" for f in os.listdir(f"{tmpdir_run}/pq") if f.endswith(".parquet"))
    with open(file, "rb") as fh:
        data = fh.read()
    torn = os.path.join(tmpdir_run, "torn.parquet")  # the footer is right, the pages are not
    with open(torn, "wb") as fh:
        fh.write(data[:4] + b"\xff" * 2000 + data[2004:])
    bad = {put(tmpdir_run, "empty.csv", "date\n"): "empty", put(tmpdir_run, "none.json", " \n"): "empty",
           put(tmpdir_run, "x.parquet", "PAR1"): "Parquet", put(tmpdir_run, "two.csv", "date,Date \n2020-01-01,x\n"): "collide",
           torn: ""}
    store = SignalStore(spark, os.path.join(tmpdir_run, "store"))
    files = [*good, *bad]
    done = load_files(store, dict(zip(files, store.allocate(len(files)))))
    assert done.rows == dict.fromkeys(good, 2)
    assert sorted(done.reasons) == sorted(bad) and all(why in done.reasons[p] for p, why in bad.items())


def test_other_failures_are_raised(spark, tmpdir_run, monkeypatch):
    def full(self, rows):
        raise OSError("no space")

    monkeypatch.setattr(SignalStore, "write_rows", full)
    with pytest.raises(OSError):
        load_files(SignalStore(spark, os.path.join(tmpdir_run, "store")), {put(tmpdir_run, "a.csv", CSV): 1})


# -- profiles ---------------------------------------------------------------------------

def test_profiles_read_no_signals(spark, tmpdir_run):
    from feedlens.operators import facets, profiles, quality
    from feedlens.plans.testbed import signals_from_tables

    store = SignalStore(spark, os.path.join(tmpdir_run, "store"))
    assert store.profiles().count() == 0
    sig = signals_from_tables(spark, "/root/testdata/sf0.001").drop("dataset_id")
    for name in ("a", "b"):
        store.append_table(sig, name)
    store.ingest(put(tmpdir_run, "junk.csv", "date,source\nnope,Reddit\n"))
    store.profiles()
    builds = os.listdir(store.profiles_path)
    store.delete(1)
    p = store.profiles()
    assert os.listdir(store.profiles_path) == builds  # nothing was counted again
    assert not any("/signals/" in f for f in p.inputFiles())
    rows = store.signals()
    for got, want in ((profiles.facet_options(p), facets.facet_options(rows)),
                      (profiles.facet_options(p, "retention"), facets.facet_options(rows, tab="retention")),
                      (profiles.non_null_counts(p), quality.non_null_counts(rows)),
                      (profiles.coverage_by_source(p), quality.coverage_by_source(rows)),
                      (profiles.rows_by_year_for_source(p, "CFPB"), quality.rows_by_year_for_source(rows, "CFPB")),
                      (profiles.rows_by_source(p), quality.rows_by_source(rows))):
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    store.delete_all()
    assert profiles.non_null_counts(store.profiles()).first()[0] == 0
