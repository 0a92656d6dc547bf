"""Reading the input tables, written intermediate tables, fixed-size bit filters, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.session import _CLEANUP, scratch_path, shuffles_dropped  # noqa: F401

from .words import release

FILE_ROWS = 1 << 18  # of a written table whose size is known


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut and lost executors cost nothing.

    The folder belongs to the run and goes with ``spark.checkpoint.dir``.  With ``rows``, a bound
    of the table's rows, a file holds about ``FILE_ROWS`` of them: each file costs renames and, on
    a local disk, several processes that the executor starts.  The last stage of ``df`` has as many tasks.
    """
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Held:
    """Intermediate tables on the executors' own disks, each computed once, until ``drop``.

    Nothing goes to the shared folder; parts of a lost executor are computed again.
    """

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables.append(df.persist(StorageLevel.DISK_ONLY))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Lets go of some tables, or of all; what was computed from them stays."""
        for df in tables or self.tables:
            df.unpersist()
        self.tables = [df for df in self.tables if tables and not any(df is x for x in tables)]


def id_text(c: str | Column) -> Column:
    """An id as text; null as the empty string."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def crc_fold(c: str | Column, folds: int = 5) -> Column:
    """crc32 of the id's text modulo ``folds``."""
    return F.crc32(id_text(c).cast("binary")) % F.lit(folds)


class BitFilter:
    """A set of 64-bit hashes as a bit table of fixed size (a Bloom filter): no false negatives.

    Two bits stand for a hash, by its upper and its lower ``bits`` bits.
    ``2 ** bits`` bits are broadcast whatever the data's size, so this is only
    ever a filter before an exact step: when the table fills up, more rows pass
    and the result stays the same.
    """

    def __init__(self, df: DataFrame, col: str, bits: int):
        places = F.array(F.shiftrightunsigned(F.col(col), 64 - bits),
                         F.col(col).bitwiseAND(F.lit((1 << bits) - 1)))
        with shuffles_dropped(df.sparkSession):
            rows = (
                df.select(F.explode(places).alias("at"))
                .select(F.shiftright("at", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("b"))
                .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
            )
        filled = np.zeros(1 << (bits - 6), np.int64)
        filled[rows["w"].to_numpy()] = rows["b"].to_numpy()
        self.bits = bits
        self.shared = df.sparkSession.sparkContext.broadcast(filled.view(np.uint64))

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes may be in the set."""
        table, out = self.shared.value, np.ones(len(hashes), bool)
        for at in (hashes >> np.uint64(64 - self.bits), hashes & np.uint64((1 << self.bits) - 1)):
            out &= ((table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` where ``fn(batch)`` yields dictionaries of Arrow arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for columns in fn(batch):
                    yield pa.RecordBatch.from_pydict(columns)
                columns = None
            batch = None
        release()

    return df.mapInArrow(run, schema)


def longs(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges``, for every node that has one.

    ``rows`` is a bound of the edges; no step makes more of them than it finds.

    Alternating large-star and small-star steps: each only needs the smallest
    neighbour of a node (a pre-aggregated minimum and a join), never the list
    of its neighbours, and the number of steps is logarithmic.
    """
    cur = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges", rows)
    before = None
    while True:
        # large star: every larger neighbour of a node goes to the smallest of the node and its neighbours
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # small star: a node, and its smaller neighbours, go to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        cur = written(small.where("u > v").distinct(), "edges", rows if before is None else before[0])
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
