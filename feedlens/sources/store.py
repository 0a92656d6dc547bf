"""Accumulative signal store and dataset registry on Parquet.

Layout under one root folder (any Hadoop file system):

    signals/dataset_id=N/*.parquet      the rows of dataset N
    compacted/generation=G/*.parquet    the rows of many small datasets, sorted by dataset_id
    moved/generation=G/*.parquet        the datasets whose rows generation G holds
    profiles/build=B/*.parquet          counts of datasets, by the call that made them
    datasets/id=N/*.parquet             the registry, one row per dataset
    ids/N                               an empty file for every id ever given
    allocations/*.parquet               ids given to staged files, by (path, time); negative when deleted
    rejected/*.parquet                  files that could not be imported, and why
    deleted/N                           an empty file for every deleted dataset that still has files
    sequence                            an id from which free ones are looked for: a hint

What must happen once is a file or folder that is created if it is absent: an
id is given by creating ``ids/N``, a dataset is published by renaming its
registry folder to ``datasets/id=N``, and a compaction by renaming its list to
``moved/generation=G``.  So an id is never given twice, also if ``sequence`` is
lost, and a dataset has one registry row whoever publishes it.

Rows are written first and registered second, and :meth:`SignalStore.signals`
shows registered datasets only.  A crash between the two leaves invisible rows:
a replayed staged import overwrites them under the same id, or
:meth:`SignalStore.reconcile` registers them (R4), under the file's name, path
and time if the id was given to a staged file, so that a later replay finds the
file imported.  Folders of datasets appear by one rename, with all their rows.

Deleting and compacting make rows invisible at once and leave their files to
:meth:`SignalStore.vacuum`, so that running queries go on.
"""

from __future__ import annotations

import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from feedlens.operators.clean import conform_shaped, transform_and_clean
from feedlens.operators.profiles import PROFILE_COLUMNS, profile_rows
from feedlens.schema import (
    ALLOCATIONS_SCHEMA, DATASETS_SCHEMA, ORPHAN_DATASET_NAME, RECOVERED_DATASET_NAME, REJECTED_SCHEMA,
    SIGNAL_COLUMNS, SIGNALS_SCHEMA,
)
from feedlens.sources import readers

_NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def _is_java(e: Py4JJavaError, name: str) -> bool:
    return e.java_exception.getClass().getSimpleName() == name


class SignalStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.signals_path = f"{self.root}/signals"
        self.datasets_path = f"{self.root}/datasets"
        self.sequence_path = f"{self.root}/sequence"
        self.allocations_path = f"{self.root}/allocations"
        self.rejected_path = f"{self.root}/rejected"
        self.ids_path = f"{self.root}/ids"
        self.deleted_path = f"{self.root}/deleted"
        self.compacted_path = f"{self.root}/compacted"
        self.moved_path = f"{self.root}/moved"
        self.profiles_path = f"{self.root}/profiles"

    # -- file system helpers (Hadoop FS through the session) --------------
    def _fs_path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs_path(path)
        return bool(fs.exists(p))

    def _delete(self, path: str) -> None:
        fs, p = self._fs_path(path)
        if fs.exists(p):
            fs.delete(p, True)

    def _has_data(self, path: str) -> bool:
        if not self._exists(path):
            return False
        fs, p = self._fs_path(path)
        return any(not s.getPath().getName().startswith(("_", "."))
                   for s in fs.listStatus(p))

    def _names(self, path: str, prefix: str = "") -> list[str]:
        """The names in a folder that begin with ``prefix``, without it."""
        fs, p = self._fs_path(path)
        if not fs.exists(p):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(p))
        return [n[len(prefix):] for n in names if n.startswith(prefix) and not n.startswith((".", "_"))]

    def _numbers(self, path: str, prefix: str = "") -> list[int]:
        return [int(n) for n in self._names(path, prefix) if n.isdigit()]

    def _create_absent(self, path: str) -> bool:
        """Creates an empty file; False if there is one already."""
        fs, p = self._fs_path(path)
        try:
            fs.create(p, False).close()
        except Py4JJavaError as e:
            if not _is_java(e, "FileAlreadyExistsException"):
                raise
            return False
        return True

    def _rename_absent(self, source: str, target: str) -> bool:
        """Renames a folder; False if there is a target already."""
        jvm = self.spark.sparkContext._jvm
        _, p = self._fs_path(target)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs_path(source)[0].getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kinds = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            files.rename(self._fs_path(source)[1], p, kinds)
        except Py4JJavaError as e:
            if not _is_java(e, "FileAlreadyExistsException"):
                raise
            return False
        return True

    def _age(self, path: str) -> float:
        """Seconds since a file or folder was last changed."""
        fs, p = self._fs_path(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    # -- reads --------------------------------------------------------------
    def signals(self, include_unpublished: bool = False) -> DataFrame:
        """The fact table of the registered datasets (empty with the fixed schema when nothing is loaded).

        ``include_unpublished`` shows rows without a registered dataset too,
        but none of deleted datasets.  The registry side of the join is small
        and prunes partitions.
        """
        rows = None
        if self._has_data(self.signals_path):
            rows = (self.spark.read.schema(SIGNALS_SCHEMA).parquet(self.signals_path)
                    .select(*SIGNALS_SCHEMA.fieldNames()))
        moved = self._moved()
        if moved is not None:
            # a dataset's rows are those of the latest generation that holds it
            if rows is not None:
                rows = rows.join(moved.select("dataset_id"), "dataset_id", "left_anti")
            there = (self.spark.read.schema(f"{SIGNALS_SCHEMA.toDDL()}, generation bigint").parquet(self.compacted_path)
                     .join(moved, ["generation", "dataset_id"], "left_semi").select(*SIGNALS_SCHEMA.fieldNames()))
            rows = there if rows is None else rows.unionByName(there)
        if rows is None:
            return self.spark.createDataFrame([], SIGNALS_SCHEMA)
        if include_unpublished:
            return self._without_deleted(rows, "dataset_id")
        return rows.join(self.registry().select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi")

    def _moved(self) -> DataFrame | None:
        """(dataset_id, generation) of the datasets in generations; None without any."""
        if not self._has_data(self.moved_path):
            return None
        return (self.spark.read.schema("dataset_id bigint, generation bigint").parquet(self.moved_path)
                .groupBy("dataset_id").agg(F.max("generation").alias("generation")))

    def _without_deleted(self, rows: DataFrame, id_: str) -> DataFrame:
        gone = self._numbers(self.deleted_path)
        if not gone:
            return rows
        return rows.join(self.spark.createDataFrame([(n,) for n in gone], f"{id_} bigint"), id_, "left_anti")

    def registry(self) -> DataFrame:
        return self._without_deleted(self._table(self.datasets_path, DATASETS_SCHEMA), "id").select(
            *DATASETS_SCHEMA.fieldNames())

    def rejected(self) -> DataFrame:
        """Files that a staged import could not load: path, time and reason."""
        return self._table(self.rejected_path, REJECTED_SCHEMA)

    def _table(self, path: str, schema) -> DataFrame:
        if not self._has_data(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path).select(*schema.fieldNames())

    def profiles(self) -> DataFrame:
        """Counts of the registered datasets for :mod:`feedlens.operators.profiles`.

        Datasets never change, so each is counted once, by the first call after
        it was registered, all new ones in one scan of theirs; otherwise no row
        of the signals is read.  Of counts made twice at once, the first build's count.
        """
        known = self._profiled()
        missing = self.registry().select(F.col("id").alias("dataset_id"))
        if known is not None:
            missing = missing.join(known, "dataset_id", "left_anti")
        if not missing.isEmpty():
            rows = self.signals().join(missing, "dataset_id", "left_semi")
            # a row for each dataset, also for one without rows
            counted = missing.select("dataset_id", F.lit("dataset").alias("dim"))
            build = self._reserve("build", self.profiles_path)
            staged = f"{self.profiles_path}/_new-{build}"
            profile_rows(rows).unionByName(counted, allowMissingColumns=True).write.parquet(staged)
            self._rename_absent(staged, f"{self.profiles_path}/build={build}")
            known = self._profiled()
        if known is None:
            return self.spark.createDataFrame([], PROFILE_COLUMNS)
        live = known.join(self.registry().select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi")
        return self._counted().join(live, ["build", "dataset_id"], "left_semi").drop("build")

    def _counted(self) -> DataFrame:
        return self.spark.read.schema(f"{PROFILE_COLUMNS}, build bigint").parquet(self.profiles_path)

    def _profiled(self) -> DataFrame | None:
        """(dataset_id, build) of the counted datasets; None without any."""
        if not self._has_data(self.profiles_path):
            return None
        return (self._counted().where("dim = 'dataset'")
                .groupBy("dataset_id").agg(F.min("build").alias("build")))

    def _reserve(self, kind: str, path: str) -> int:
        """A number that no other call gets, for a folder ``kind=number`` in ``path``."""
        n = max([0, *self._numbers(path, f"{kind}="), *self._numbers(self.ids_path, f"{kind}-")])
        while True:
            n += 1
            if self._create_absent(f"{self.ids_path}/{kind}-{n}"):
                return n

    def datasets(self) -> DataFrame:
        """Registry rows, newest first (id breaks ties)."""
        return (self.registry().select("id", "name", "loaded_at", "row_count")
                .orderBy(F.desc("loaded_at"), F.desc("id")))

    def summary(self) -> DataFrame:
        """Number of datasets and total registered rows, one row."""
        return self.registry().agg(
            F.count(F.lit(1)).alias("datasets"),
            F.coalesce(F.sum("row_count"), F.lit(0)).cast("bigint").alias("rows"))

    # -- ids ------------------------------------------------------------------
    def _hint(self) -> int:
        """Where to look for free ids: the content of the sequence file; without one, the highest id known."""
        fs, p = self._fs_path(self.sequence_path)
        try:
            stream = fs.open(p)
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
            stream.close()
            if text.isdigit():
                return int(text)
        except Py4JJavaError:  # absent or torn: no more than a hint is lost
            pass
        bound = self._table(self.allocations_path, ALLOCATIONS_SCHEMA).agg(F.max("id")).first()[0]
        return max([0, bound or 0, *self._numbers(self.ids_path), *self._numbers(self.datasets_path, "id="),
                    *self._numbers(self.signals_path, "dataset_id=")])

    def allocate(self, n: int = 1) -> list[int]:
        """``n`` ids that were never given; each is reserved by its file before it is used."""
        if n == 0:
            return []
        given, id_ = [], self._hint()
        while len(given) < n:
            id_ += 1
            if self._create_absent(f"{self.ids_path}/{id_}"):
                given.append(id_)
        self._remember(id_)
        return given

    def _remember(self, last: int) -> None:
        fs, p = self._fs_path(self.sequence_path)
        out = fs.create(p, True)
        out.write(f"{last}\n".encode())
        out.close()

    def bind(self, files: list[tuple]) -> list[int]:
        """An id for each staged (path, time): the one it already has and was not deleted, else a new one.

        The binding is written before any data, so a replay after a crash
        finds it and overwrites what the first attempt left.
        """
        if not files:
            return []
        asked = self.spark.createDataFrame(files, "source_path string, source_mtime timestamp")
        known = {(r["source_path"], r["source_mtime"]): r["id"]
                 for r in self._table(self.allocations_path, ALLOCATIONS_SCHEMA)
                 .join(asked, ["source_path", "source_mtime"]).groupBy("source_path", "source_mtime")
                 .agg(F.max("id").alias("id"), F.min("id").alias("released"))
                 .where("id + released > 0").collect()}
        new = [f for f in files if f not in known]
        fresh = dict(zip(new, self.allocate(len(new))))
        if fresh:
            (self.spark.createDataFrame([(i, *f) for f, i in fresh.items()], ALLOCATIONS_SCHEMA)
             .coalesce(1).write.mode("append").parquet(self.allocations_path))
        return [known.get(f) or fresh[f] for f in files]

    def register(self, rows: list[tuple]) -> list[int]:
        """Publishes datasets: (id, name, row_count, source path or None, its time or None) each.

        An id that has a registry row keeps it.  Returns the ids that had none.
        """
        if not rows:
            return []
        return self._register(self.spark.createDataFrame(
            rows, "id bigint, name string, row_count bigint, source_path string, source_mtime timestamp"))

    def _register(self, rows: DataFrame) -> list[int]:
        """One write of all rows beside the registry, then a rename for each, which publishes it."""
        staged = f"{self.datasets_path}/_new-{uuid.uuid4().hex}"
        (rows.withColumn("loaded_at", F.current_timestamp()).select(*DATASETS_SCHEMA.fieldNames())
         .repartition("id").write.partitionBy("id").parquet(staged))
        try:
            return [n for n in sorted(self._numbers(staged, "id="))
                    if self._rename_absent(f"{staged}/id={n}", f"{self.datasets_path}/id={n}")]
        finally:
            self._delete(staged)

    def reject(self, rows: list[tuple]) -> None:
        """Records (path, time, reason) of files that were not, or not wholly, imported."""
        if rows:
            (self.spark.createDataFrame(rows, REJECTED_SCHEMA).coalesce(1)
             .write.mode("append").parquet(self.rejected_path))

    # -- writes ---------------------------------------------------------------
    # Columns the written rows are sorted by inside each task: the filters used
    # most (period, channel) then skip Parquet row groups by their min/max.
    CLUSTER_BY = ("year", "source")
    # Rows of a compacted file.  Sorted rows take a tenth of their bytes as a file: by these alone, the task that
    # writes a file would read gigabytes.
    FILE_ROWS = 4_000_000

    def write_rows(self, rows: DataFrame) -> None:
        """Writes the rows of one or many datasets (by dataset_id), replacing what earlier attempts left of them.

        The tasks that make the rows write them (no repartition by dataset id,
        which would send a dataset through one task), sorted within each task
        by ``CLUSTER_BY`` so that Parquet statistics skip row groups.  Each
        dataset's folder appears by one rename, with all its rows.
        """
        (rows.select("dataset_id", *SIGNAL_COLUMNS)
         .sortWithinPartitions("dataset_id", *self.CLUSTER_BY)  # per task: no shuffle
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("dataset_id").parquet(self.signals_path))

    def write_partition(self, clean: DataFrame, dataset_id: int) -> int:
        """S10 for one dataset; returns the number of its rows, which are counted as they are written."""
        count = Observation()
        self.write_rows(clean.observe(count, F.count(F.lit(1)).alias("n"))
                        .withColumn("dataset_id", F.lit(int(dataset_id)).cast("bigint")))
        return int(count.get["n"])

    def row_counts(self, ids: list[int]) -> dict[int, int]:
        """Rows in the folders of datasets, from the files' footers; for at most a batch of ids."""
        if not self._has_data(self.signals_path):
            return {}
        rows = self.spark.read.schema(SIGNALS_SCHEMA).parquet(self.signals_path).where(F.col("dataset_id").isin(ids))
        return {r["dataset_id"]: r["count"] for r in rows.groupBy("dataset_id").count().collect()}

    def load(self, clean: DataFrame, name: str, source_path: str | None = None,
             source_mtime=None) -> int:
        """Append a cleaned frame as a new dataset; returns its id.  Never deduplicates."""
        id_ = self.allocate()[0]
        self.register([(id_, name, self.write_partition(clean, id_), source_path, source_mtime)])
        return id_

    def prepare(self, path: str, multi_line: bool | None = None) -> tuple[str, str, DataFrame]:
        """(file, stem, raw frame) of a file, or of the best file of a folder (S5); an empty one is an error."""
        target = path
        if not readers.extension(path):
            best = readers.pick_best_file(readers.list_files(self.spark, path), path).first()
            if best is None:
                raise FileNotFoundError(f"no data file (.csv, .parquet, .json, .jsonl) in {path}")
            target = best["path"]
        raw = readers.route_to_reader(self.spark, target, multi_line)
        if raw.isEmpty():
            raise ValueError(f"the file {os.path.basename(target)!r} is empty")
        return target, os.path.splitext(os.path.basename(target.rstrip("/")))[0], raw

    def write_raw(self, raw: DataFrame, dataset_id: int) -> tuple[int, int]:
        """Cleans and writes a raw frame: (rows written, records that did not parse)."""
        if readers.MALFORMED not in raw.columns:
            return self.write_partition(transform_and_clean(raw), dataset_id), 0
        seen = Observation()
        raw = raw.observe(seen, F.count_if(F.col(readers.MALFORMED).isNotNull()).alias("bad"))
        return self.write_partition(transform_and_clean(raw), dataset_id), int(seen.get["bad"])

    def ingest(self, path: str, name: str | None = None, source_mtime=None,
               multi_line: bool | None = None) -> int:
        """Load one file (or a folder: S5 picks the file) end to end.

        The default name is the file stem.  An empty source is an error; a
        file whose rows are all dropped by cleaning still registers 0 rows.
        Records that do not parse are reported in :meth:`rejected`.
        """
        target, stem, raw = self.prepare(path, multi_line)
        id_ = self.allocate()[0]
        n, bad = self.write_raw(raw, id_)
        self.register([(id_, name or stem, n, target, source_mtime)])
        if bad:
            self.reject([(target, source_mtime, f"{bad} malformed records")])
        return id_

    def append_table(self, df: DataFrame, name: str) -> int:
        """Append an already-shaped signal table without cleaning, in one pass.

        Without rows, or with values that the schema cannot hold, it is an
        error: both are counted as the rows are written, and nothing is
        published then.
        """
        seen = Observation()
        rows = conform_shaped(df, observe=lambda raw, unfit: raw.observe(
            seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(bad).alias(c) for c, bad in unfit.items()]))
        id_ = self.allocate()[0]
        n = self.write_partition(rows, id_)
        unfit = {c: k for c, k in seen.get.items() if c != "rows" and k}
        if not n or unfit:
            self._delete(f"{self.signals_path}/dataset_id={id_}")
            raise ValueError(f"values that the schema cannot hold, by column: {unfit}" if unfit
                             else "the table has no rows")
        self.register([(id_, name, n, None, None)])
        return id_

    # -- deletion, compaction ---------------------------------------------------
    def delete(self, dataset_id: int) -> None:
        """R2: the dataset is invisible at once; its files go with :meth:`vacuum`."""
        id_ = int(dataset_id)
        if self._exists(f"{self.datasets_path}/id={id_}") or self._exists(f"{self.signals_path}/dataset_id={id_}"):
            self._release(self.registry().where(F.col("id") == id_))
            self._create_absent(f"{self.deleted_path}/{id_}")

    def _release(self, datasets: DataFrame) -> None:
        """Staged files of deleted datasets may be imported again, under new ids."""
        files = datasets.where(F.col("source_mtime").isNotNull()).select(
            (-F.col("id")).alias("id"), "source_path", "source_mtime")
        if not files.isEmpty():
            files.write.mode("append").parquet(self.allocations_path)

    def delete_all(self) -> None:
        """Every dataset, and rows without one, are deleted as by :meth:`delete`; their ids stay reserved."""
        self._adopt_null_rows()
        self._release(self.registry())
        for id_ in {*self._numbers(self.datasets_path, "id="), *self._numbers(self.signals_path, "dataset_id=")}:
            self._create_absent(f"{self.deleted_path}/{id_}")

    def _adopt_null_rows(self) -> int | None:
        """Gives rows with a NULL dataset id a new one by renaming their folder; None without such rows."""
        null_part = f"{self.signals_path}/dataset_id={_NULL_PARTITION}"
        if not self._has_data(null_part):
            return None
        id_ = self.allocate()[0]
        self._rename_absent(null_part, f"{self.signals_path}/dataset_id={id_}")
        return id_

    def compact(self, small_bytes: int = 64 << 20, target_bytes: int = 128 << 20) -> int:
        """Moves the datasets smaller than ``small_bytes`` to files of about ``target_bytes``, or
        ``FILE_ROWS`` rows if these take less; returns the datasets' number.

        These files hold many datasets each, sorted by dataset_id, whose
        statistics prune them.  So the files that :meth:`signals` lists grow
        with the bytes loaded and not with the number of datasets.  The move
        takes effect by one rename; the old folders go with :meth:`vacuum`.
        """
        if not self._has_data(self.signals_path):
            return 0
        files = readers.list_files(self.spark, self.signals_path).select(
            F.regexp_extract("path", r"/dataset_id=(\d+)/", 1).try_cast("bigint").alias("dataset_id"), "length")
        small = files.groupBy("dataset_id").agg(F.sum("length").alias("length")).where(F.col("length") < small_bytes)
        moved = self._moved()
        if moved is not None:
            small = small.join(moved, "dataset_id", "left_anti")
        small = small.join(self.registry().select(F.col("id").alias("dataset_id"), "row_count"), "dataset_id")
        found = small.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"), F.sum("row_count").alias("rows")).first()
        if found["n"] < 2:
            return 0
        rows = self.spark.read.schema(SIGNALS_SCHEMA).parquet(self.signals_path)
        self._move(rows.join(small, "dataset_id", "left_semi"), small,
                   max(-(-found["length"] // target_bytes), -(-found["rows"] // self.FILE_ROWS)))
        return int(found["n"])

    def _move(self, rows: DataFrame, datasets: DataFrame, n_files: int) -> None:
        """Writes rows as a new generation, which holds ``datasets`` from then on.

        Ranges are cut within equal values of the order too, by the whole row,
        so that no value's rows go through one task.
        """
        generation = self._reserve("generation", self.compacted_path)
        (rows.select(*SIGNALS_SCHEMA.fieldNames())
         .repartitionByRange(max(1, int(n_files)), "dataset_id", *self.CLUSTER_BY, F.xxhash64(*SIGNAL_COLUMNS))
         .sortWithinPartitions("dataset_id", *self.CLUSTER_BY)
         .write.parquet(f"{self.compacted_path}/generation={generation}"))
        staged = f"{self.moved_path}/_new-{generation}"
        datasets.select("dataset_id").coalesce(1).write.parquet(staged)
        self._rename_absent(staged, f"{self.moved_path}/generation={generation}")

    def vacuum(self, older_than: float = 7 * 86400.0) -> None:
        """Removes the files of datasets deleted or moved more than ``older_than`` seconds ago.

        No query that may still read them should be running.  Generations with
        rows of deleted datasets are written anew without them.  A crash
        leaves what the next call removes.
        """
        deleted = [n for n in self._numbers(self.deleted_path) if self._age(f"{self.deleted_path}/{n}") >= older_than]
        if self._has_data(self.moved_path):
            self._vacuum_generations(deleted, older_than)
        for id_ in deleted:
            # the mark goes last: without it, rows that are left would be taken for lost ones
            self._delete(f"{self.signals_path}/dataset_id={id_}")
            self._delete(f"{self.datasets_path}/id={id_}")
        still = set()
        if deleted and self._has_data(self.compacted_path):
            gone = self.spark.createDataFrame([(n,) for n in deleted], "dataset_id bigint")
            rows = self.spark.read.schema(SIGNALS_SCHEMA).parquet(self.compacted_path)
            still = {r[0] for r in gone.join(rows, "dataset_id", "left_semi").collect()}
        for id_ in set(deleted) - still:
            self._delete(f"{self.deleted_path}/{id_}")

    def _vacuum_generations(self, deleted: list[int], older_than: float) -> None:
        old = [g for g in self._numbers(self.moved_path, "generation=")
               if self._age(f"{self.moved_path}/generation={g}") >= older_than]
        if not old:
            return
        moved = self._moved()
        # folders of datasets that a generation holds
        folders = self.spark.createDataFrame([(n,) for n in self._numbers(self.signals_path, "dataset_id=")],
                                             "dataset_id bigint")
        for r in folders.join(moved.where(F.col("generation").isin(old)), "dataset_id", "left_semi").toLocalIterator():
            self._delete(f"{self.signals_path}/dataset_id={r['dataset_id']}")
        gone = self.spark.createDataFrame([(n,) for n in deleted], "dataset_id bigint")
        judged = (moved.where(F.col("generation").isin(old)).join(gone.withColumn("gone", F.lit(1)), "dataset_id", "left")
                  .groupBy("generation").agg(F.count("gone").alias("gone"), F.count(F.lit(1)).alias("all")))
        hit = [r["generation"] for r in judged.collect() if 0 < r["gone"] < r["all"]]
        if hit:
            kept = moved.where(F.col("generation").isin(hit)).join(gone, "dataset_id", "left_anti")
            paths = [f"{self.compacted_path}/generation={g}" for g in hit]
            rows = (self.spark.read.schema(f"{SIGNALS_SCHEMA.toDDL()}, generation bigint").parquet(self.compacted_path)
                    .join(kept, ["generation", "dataset_id"], "left_semi"))
            size = sum(self._fs_path(p)[0].getContentSummary(self._fs_path(p)[1]).getLength() for p in paths)
            # the deleted datasets are in no generation then; what is read now goes with a later call
            n = kept.join(self.registry().select(F.col("id").alias("dataset_id"), "row_count"), "dataset_id").agg(
                F.sum("row_count")).first()[0] or 0
            self._move(rows, kept, max(-(-size // (128 << 20)), -(-n // self.FILE_ROWS)))
        # generations that hold no dataset any more, and unpublished ones
        current = self._moved()
        if deleted:
            current = current.join(gone, "dataset_id", "left_anti")
        live = {r[0] for r in current.select("generation").distinct().collect()}
        for g in self._numbers(self.compacted_path, "generation="):
            published = self._exists(f"{self.moved_path}/generation={g}")
            mark = f"{self.moved_path}/generation={g}" if published else f"{self.compacted_path}/generation={g}"
            if g not in live and g not in hit and self._age(mark) >= older_than:
                self._delete(f"{self.compacted_path}/generation={g}")
                self._delete(f"{self.moved_path}/generation={g}")

    def reconcile(self) -> DataFrame:
        """Register what the registry misses; idempotent.

        (a) rows with a NULL dataset id move to one new "recovered" dataset: their
        folder is renamed, so that a crash loses and doubles nothing; (b) every
        other dataset id present in the signals but neither in the registry nor
        deleted gets a registry row with its row count (a group-by and an anti
        join).  An id that was given to a staged file is registered as its
        import would have done it.  Registry rows without signals are left
        alone.  Returns the registry rows added.
        """
        before = self.registry().select("id")
        adopted = self._adopt_null_rows()
        if adopted is not None:
            n = self.signals(include_unpublished=True).where(F.col("dataset_id") == adopted).count()
            self.register([(adopted, RECOVERED_DATASET_NAME, n, None, None)])
        missing = (self.signals(include_unpublished=True).where(F.col("dataset_id").isNotNull())
                   .groupBy(F.col("dataset_id").alias("id")).agg(F.count(F.lit(1)).alias("row_count"))
                   .join(self.registry().select("id"), "id", "left_anti"))
        if not missing.isEmpty():
            prefix, suffix = ORPHAN_DATASET_NAME.split("{id}")
            staged = (self._table(self.allocations_path, ALLOCATIONS_SCHEMA).groupBy("id")
                      .agg(F.max("source_path").alias("source_path"), F.max("source_mtime").alias("source_mtime")))
            file = F.element_at(F.split("source_path", "/"), -1)
            stem = F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")
            added = self._register(missing.join(staged, "id", "left").select(
                "id", F.coalesce(stem, F.concat(F.lit(prefix), F.col("id").cast("string"), F.lit(suffix))).alias("name"),
                "row_count", "source_path", "source_mtime"))
            for id_ in added:
                self._create_absent(f"{self.ids_path}/{id_}")
            if added:
                self._remember(max(self._hint(), *added))
        return self.registry().join(before, "id", "left_anti")

    # -- discovery ----------------------------------------------------------
    def scan_available(self, staging_dir: str) -> DataFrame:
        """Importable CSV files under ``staging_dir`` (recursive).

        name, path, size_bytes, ext, imported (stem already a registered
        name), sorted by lower(name).  Only path/length are listed; file
        contents are not read.  The parts of a file in parts may be compressed.
        """
        listing = (readers.list_files(self.spark, staging_dir, glob="*.{[cC][sS][vV],[cC][sS][vV].[gG][zZ]}")
                   .where(~F.lower("name").endswith(".gz")))
        names = self.registry().select(F.col("name").alias("stem")).distinct()
        stem = F.regexp_replace("name", r"\.[^.]*$", "")
        return (listing.where(readers.not_hidden())
                .withColumn("stem", stem)
                .join(names.withColumn("imported", F.lit(True)), "stem", "left")
                .select("name", "path", F.col("length").alias("size_bytes"),
                        F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).alias("ext"),
                        F.coalesce(F.col("imported"), F.lit(False)).alias("imported"))
                .orderBy(F.lower("name"), "path"))

    def pending(self, staging_dir: str) -> DataFrame:
        """Discovered files not imported yet."""
        return self.scan_available(staging_dir).where(~F.col("imported"))
