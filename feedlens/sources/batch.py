"""Loading many files at once, each as a dataset of its own.

All files of a batch are read by plans that do not depend on their number: CSV
files of one header together, Parquet files of one schema together, JSON files
together.  A row's file is in its metadata; a join with the list of files, of
at most a batch, gives its dataset id, and one write makes all datasets'
folders.  The number of Spark jobs depends on the number of distinct headers
and schemas only.

A file that cannot be loaded gets a reason and stops no other one: headers,
schemas and empty files are judged before anything is read.  If the write fails
because of a file, the batch is halved until that file is alone.  Other
failures are raised.
"""

from __future__ import annotations

import os
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from feedlens.operators.clean import transform_and_clean
from feedlens.sources import readers
from feedlens.sources.readers import MALFORMED, SOURCE_FILE
from feedlens.sources.store import SignalStore

# Error classes of Spark that speak of a file's content, header or name
FILE_CONDITIONS = {
    "FAILED_READ_FILE", "PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "COLUMN_ALREADY_EXISTS", "AMBIGUOUS_REFERENCE",
    "CANNOT_MERGE_SCHEMAS", "MALFORMED_RECORD_IN_PARSING", "MALFORMED_CSV_RECORD",
}


@dataclass
class Loaded:
    """Per path: the rows of a loaded file, or why it, or some of its records, could not be loaded."""

    rows: dict[str, int] = field(default_factory=dict)
    reasons: dict[str, str] = field(default_factory=dict)


def is_file_error(e: Exception) -> bool:
    """Whether a load failed because of a file, and would fail again."""
    if isinstance(e, (ValueError, FileNotFoundError)):
        return True
    if isinstance(e, PySparkException) and (e.getCondition() or "").split(".")[0] in FILE_CONDITIONS:
        return True
    cause = e.java_exception if isinstance(e, Py4JJavaError) else getattr(e, "_origin", None)
    while cause is not None:
        # errors of Spark name their class; it stands in the chain of causes where a task failed
        if hasattr(cause, "getCondition") and str(_condition(cause)).split(".")[0] in FILE_CONDITIONS:
            return True
        cause = cause.getCause()
    return False


def _condition(cause) -> str | None:
    try:
        return cause.getCondition()
    except Exception:  # py4j: this Java class has no such method
        return None


def _message(e: Exception) -> str:
    return str(e).splitlines()[0][:500]


def _empty(path: str) -> str:
    return f"the file {os.path.basename(path)!r} is empty"


def parquet_footer(store: SignalStore, path: str) -> tuple[str, int]:
    """(schema, number of rows) of a Parquet file, without a Spark job; ValueError if it is none."""
    jvm = store.spark.sparkContext._jvm
    conf = store.spark.sparkContext._jsc.hadoopConfiguration()
    try:
        file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    except Py4JJavaError as e:
        kind = e.java_exception.getClass().getName()
        if kind != "java.lang.RuntimeException" and "parquet" not in kind and "FileNotFound" not in kind:
            raise
        raise ValueError(e.java_exception.getMessage()) from None
    try:
        return reader.getFooter().getFileMetaData().getSchema().toString(), int(reader.getRecordCount())
    finally:
        reader.close()


def _frames(store: SignalStore, uri: dict[str, str], multi_line: bool | None,
            out: Loaded) -> list[tuple[DataFrame, list[str]]]:
    """(raw rows with their file, paths) of the files that can be read, one for each header, schema or format."""
    spark, frames, paths = store.spark, [], list(uri)
    kind = {p: readers.extension(p) for p in paths}

    csv = [p for p in paths if kind[p] == ".csv"]
    if csv:
        groups = {}
        seen = {r["path"]: r for r in readers.csv_profile(spark, csv).collect()}  # a row for each file of the batch
        for p in csv:
            r = seen.get(uri[p])
            if r is None or r["lines"] < 2:
                out.reasons[p] = _empty(p)
            else:
                groups.setdefault((r["header"], r["spans"] if multi_line is None else multi_line), []).append(p)
        for (header, spans), group in groups.items():
            frames.append((readers.read_csv(spark, group, spans, header, keep_path=True), group))

    groups = {}
    for p in paths:
        if kind[p] == ".parquet":
            try:
                schema, n = parquet_footer(store, p)
            except ValueError as e:
                out.reasons[p] = _message(e)
                continue
            if n:
                groups.setdefault(schema, []).append(p)
            else:
                out.reasons[p] = _empty(p)
    frames += [(readers.read_parquet(spark, group, keep_path=True), group) for group in groups.values()]

    lines = [p for p in paths if kind[p] in (".json", ".jsonl")]
    if lines:
        seen = {r["path"]: r for r in readers.json_profile(spark, lines).collect()}  # a row for each file of the batch
        filled = [p for p in lines if uri[p] in seen and seen[uri[p]]["records"] + seen[uri[p]]["others"]]
        out.reasons.update({p: _empty(p) for p in lines if p not in filled})
        if filled:
            frames.append((readers.read_json(spark, filled, keep_path=True), filled))
    return frames


def load_files(store: SignalStore, ids: dict[str, int], multi_line: bool | None = None) -> Loaded:
    """Writes the rows of files (path to dataset id), cleaned; registers nothing.

    A file with malformed records is loaded without them and has a reason too.
    ``multi_line`` is as in :func:`feedlens.sources.readers.read_csv`.
    """
    out = Loaded()
    if not ids:
        return out
    try:
        _load(store, ids, multi_line, out)
    except Exception as e:
        if not is_file_error(e):
            raise
        out = Loaded()
        if len(ids) == 1:
            out.reasons[next(iter(ids))] = _message(e)
            return out
        files = list(ids.items())
        for half in (files[:len(files) // 2], files[len(files) // 2:]):
            done = load_files(store, dict(half), multi_line)
            out.rows.update(done.rows)
            out.reasons.update(done.reasons)
    return out


def _load(store: SignalStore, ids: dict[str, int], multi_line: bool | None, out: Loaded) -> None:
    spark, cleaned, json_rows, seen = store.spark, [], None, Observation()
    loaded: list[str] = []
    # a folder with a data extension is one file in parts
    owner = {part: p for p in ids for part in readers.file_parts(spark, p)}
    uri = {p: readers.file_uri(spark, p) for p in owner}
    found = Loaded()
    frames = _frames(store, uri, multi_line, found)
    filled = {owner[p] for p in owner if p not in found.reasons}
    for part, reason in found.reasons.items():
        p = owner[part]
        if p == part:
            out.reasons[p] = reason
        elif reason != _empty(part):
            out.reasons.setdefault(p, f"{os.path.basename(part)}: {reason}")
    # empty parts are no fault of a file that has others
    out.reasons.update({p: _empty(p) for p in ids if p not in filled and p not in out.reasons})
    for raw, group in frames:
        if MALFORMED in raw.columns:
            json_rows = raw
            raw = raw.observe(seen, F.count_if(F.col(MALFORMED).isNotNull()).alias("bad"))
        try:
            cleaned.append(transform_and_clean(raw, [SOURCE_FILE]))
        except ValueError as e:  # names that collide: all files of this header
            out.reasons.update({owner[p]: _message(e) for p in group})
            continue
        loaded += group
    # a file in parts is loaded whole or not at all
    path_of = {uri[p]: owner[p] for p in loaded if owner[p] not in out.reasons}
    loaded = sorted(set(path_of.values()))
    if not loaded:
        return
    # one row for each file of the batch, and each part
    names = spark.createDataFrame([(u, ids[p]) for u, p in path_of.items()], f"{SOURCE_FILE} string, dataset_id bigint")
    store.write_rows(reduce(DataFrame.unionByName, cleaned).join(F.broadcast(names), SOURCE_FILE))
    counts = store.row_counts([ids[p] for p in loaded])
    out.rows.update({p: counts.get(ids[p], 0) for p in loaded})
    if json_rows is not None and seen.get["bad"]:
        bad = json_rows.where(F.col(MALFORMED).isNotNull()).groupBy(SOURCE_FILE).count()
        torn = Counter()
        for r in bad.collect():
            if r[SOURCE_FILE] in path_of:
                torn[path_of[r[SOURCE_FILE]]] += r["count"]
        out.reasons.update({p: f"{n} malformed records" for p, n in torn.items()})
