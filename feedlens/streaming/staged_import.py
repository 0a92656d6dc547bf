"""Staged-file import as a Structured Streaming job.

The stream is the LISTING of a staging folder (``binaryFile`` source; only
path, modification time and length are selected, so file contents are not
read by the stream).  Each micro-batch hands its new paths to
:func:`feedlens.sources.batch.load_files`, which loads them as one dataset per
file (S7), as the reference's import does, by plans of many files.  A folder
with a data extension is one file in parts; it should be staged by one rename,
as a folder that changes is a changed file.  A CSV
stream with a fixed schema is deliberately not used: Spark would bind columns
by position and break header normalisation (C1) and missing columns (C2).

``foreachBatch`` is at-least-once.  Before any data is written, each file's
(path, modification time) is bound to a dataset id in the store; a replayed
batch skips what is registered or rejected and overwrites the rest under the
same ids, so a file is never loaded twice, wherever the first attempt stopped.
A file that cannot be imported is recorded in the store's rejected table with
the reason; failures that are no fault of a file stop the batch, which is
then run again.  Cleaning is stateless; no watermark is needed.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.schema import HIDDEN_PREFIXES
from feedlens.session import checkpoint_dir
from feedlens.sources import readers
from feedlens.sources.batch import load_files
from feedlens.sources.store import SignalStore

DATA_GLOB = "*.{[cC][sS][vV],[pP][aA][rR][qQ][uU][eE][tT],[jJ][sS][oO][nN],[jJ][sS][oO][nN][lL]}"
# the fixed schema of Spark's binaryFile source
LISTING_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def _load_batch(store: SignalStore, batch: DataFrame, staging_dir: str, multi_line: bool | None = None) -> None:
    key = ["source_path", "source_mtime"]
    hidden = F.lit(False)
    for prefix in HIDDEN_PREFIXES:
        hidden = hidden | F.element_at(F.split("path", "/"), -1).startswith(prefix)
    # a micro-batch lists at most maxFilesPerTrigger new files: a bounded collect
    named = batch.where(~hidden).select(F.col("path").alias(key[0]), F.col("modificationTime").alias(key[1]))
    # a file in parts has the latest time of all its parts, whichever of them this batch lists
    parts = {r[0]: readers.file_parts(store.spark, r[0]) for r in named.select(key[0]).distinct().collect()}
    folders = {p: x for p, x in parts.items() if x != [p]}
    if folders:
        listing = readers.list_files(store.spark, [x for group in folders.values() for x in group], below=staging_dir)
        named = named.where(~F.col(key[0]).isin(list(folders))).union(listing.select("path", "modificationTime"))
    files = [tuple(r) for r in (
        named.distinct()
        .join(store.registry().select(*key), key, "left_anti")
        .join(store.rejected().select(*key), key, "left_anti").orderBy(*key).collect())]
    ids = dict(zip(files, store.bind(files)))
    done = load_files(store, {path: ids[path, mtime] for path, mtime in files}, multi_line)
    stem = {path: os.path.splitext(path.rsplit("/", 1)[-1])[0] for path, _ in files}
    store.register([(ids[f], stem[f[0]], done.rows[f[0]], *f) for f in files if f[0] in done.rows])
    store.reject([(*f, done.reasons[f[0]]) for f in files if f[0] in done.reasons])


def start_staged_import(spark: SparkSession, store: SignalStore, staging_dir: str,
                        checkpoint: str | None = None, available_now: bool = True,
                        max_files_per_trigger: int = 100, processing_time: str = "10 seconds",
                        multi_line: bool | None = None):
    """Start the import stream; returns the ``StreamingQuery``.

    ``available_now=True`` loads what is staged and stops; otherwise the
    folder is polled every ``processing_time``.  ``multi_line`` is as in
    :func:`feedlens.sources.readers.read_csv`.  The checkpoint defaults to a
    folder under the session's shared checkpoint directory.
    """
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/staged-import"
    listing = (spark.readStream.format("binaryFile").schema(LISTING_SCHEMA)
               .option("recursiveFileLookup", True)
               .option("pathGlobFilter", DATA_GLOB)
               .option("maxFilesPerTrigger", max_files_per_trigger)
               .load(staging_dir)
               .select(readers.data_path(spark, staging_dir).alias("path"), "modificationTime", "length"))
    writer = (listing.writeStream
              .foreachBatch(lambda df, _: _load_batch(store, df, staging_dir, multi_line))
              .option("checkpointLocation", ckpt))
    if available_now:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def import_staged(spark: SparkSession, store: SignalStore, staging_dir: str,
                  checkpoint: str | None = None, multi_line: bool | None = None) -> None:
    """Run the stream once over everything staged and wait for it."""
    q = start_staged_import(spark, store, staging_dir, checkpoint, available_now=True, multi_line=multi_line)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
