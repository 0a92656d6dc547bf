"""Mixing sources to target weights along a time-varying curriculum.

Sources in code-point order (null last) weigh ``weights``, repeating, and share
``budget`` times the corpus's words.  No source gets more than ``most`` times
its own words; the excess is shared again by weight among the rest until none
is above.

Each source has a weight schedule over training time 0 .. 1, a broken line
through knots.  Its integral is the source's cumulative demand for words; a
document that stands at so many words of its source's demand is trained at the
time at which the demand reaches that point (the inverted integral).  Within a
source, documents follow a fixed pseudo-random order of doc_id, epoch after
epoch; only the last document of a source's last epoch may be taken in part.
Positions from all sources are then range-sorted into one training order.

Running sums never gather a source in one task: each source's order is cut
into ``BUCKETS`` hash buckets, bucket totals are summed per source, and
documents are summed inside their bucket.

Defined cases: null text has size 0; sizes of 0 are taken 0 times; a null
source is a source; every row is a document, also rows with equal or null
doc_ids and rows equal in all; an empty table gives an empty mix; other columns
are kept by ``mix`` and not read, and an error if they begin with ``mix_``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import map_arrow, written

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
BUCKETS = 4096
# Relative weight at knots of training time, one schedule per weight, repeating: the heavy
# sources come early, the light ones rise to the end, the middle ones peak half-way.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.75), (0.5, 1.25), (1.0, 0.75)))


# What tells documents apart; rows equal in these are numbered
KEY = ("doc_id", "source", "text_hash")
# Equal rows that one task numbers at once
_CHUNK = 1 << 16


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, text_hash): the documents' word counts."""
    def emit(batch):
        n = W.count_words(batch.column(2))
        yield {"doc_id": batch.column(0), "source": batch.column(1), "size": pa.array(n, pa.int64()),
               "text_hash": batch.column(3)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("source").cast("string"), F.col("text").cast("string"),
                       F.xxhash64("text").alias("text_hash"))
    return map_arrow(rows, emit, f"doc_id {kind}, source string, size long, text_hash long")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET,
                   most: float = MOST) -> DataFrame:
    """(source, source_size, rank, target); one row per source, null last.

    The result is the water level at which capped sources and the weighted rest
    add up to the budget.  Each round is one aggregate over the sources; only
    its sums come to the driver, and each round caps a source or ends.
    """
    totals = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    # one row per source: ranked in one task, as sources are labels and not documents
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = written(
        totals.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                           (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most))), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, want = 0.0, budget * total
    while True:
        capped = F.col("weight") * F.lit(level) >= F.col("cap")
        full, free = ranked.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not free:
            break
        higher = (want - (full or 0.0)) / free
        if higher <= level:
            break
        level = higher
    return ranked.select("source", "source_size", "rank",
                         F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def _when_reached(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which a schedule's integral reaches ``share`` of the whole."""
    pieces, area = [], 0.0
    for (t0, a), (t1, b) in zip(knots[:-1], knots[1:]):
        pieces.append((area, t0, t1, a, b))
        area += (a + b) / 2 * (t1 - t0)
    out = None
    for before, t0, t1, a, b in pieces:
        d = F.greatest(share * area - before, F.lit(0.0))  # demand into this piece
        slope = (b - a) / (t1 - t0)
        if abs(slope) < 1e-12:
            t = t0 + d / a
        else:  # a x + slope x**2 / 2 = d, in the form that is stable for small slopes
            t = t0 + 2 * d / F.greatest(F.sqrt(F.greatest(a * a + 2 * slope * d, F.lit(0.0))) + a, F.lit(1e-12))
        t = F.least(t, F.lit(t1))
        out = t if out is None else F.when(share * area >= before, t).otherwise(out)
    return out


def training_time(share: Column, rank: Column, schedules=SCHEDULES) -> Column:
    out = None
    for i, knots in enumerate(schedules):
        t = _when_reached(share, knots)
        out = F.when(rank % len(schedules) == i, t) if out is None else out.when(rank % len(schedules) == i, t)
    return out


def assign(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST,
           schedules=SCHEDULES) -> DataFrame:
    """Per document: (doc_id, source, text_hash, number, size, source_size, target, taken, copies).

    Rows equal in doc_id, source and text have a ``number`` from 0 on.
    ``copies`` lists (copy, words, position): each time the document is trained
    on, the words taken and the training time at which they begin.
    """
    return _assign(_counted(docs), weights, budget, most, schedules)


def _counted(docs: DataFrame) -> DataFrame:
    """Documents and how many rows are equal to each, as a written table."""
    return written(sizes(docs).groupBy(*KEY, "size").agg(F.count(F.lit(1)).alias("rows")), "sizes")


def _numbered(counted: DataFrame) -> DataFrame:
    """A row for each document row, equal ones numbered and in a place each; groups of any size are cut in chunks."""
    chunks = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / _CHUNK).cast("int"))))
    first = F.col("chunk").cast("long") * _CHUNK
    numbered = (chunks.repartition(*KEY, "chunk")
                .withColumn("number", F.explode(F.sequence(first, F.least(F.col("rows"), first + _CHUNK) - 1))))
    place = (F.when(F.col("doc_id").isNull(), F.xxhash64("text_hash", "source", F.lit("mix"), "number"))
             .when(F.col("number") > 0, F.xxhash64("doc_id", F.lit("mix"), "number"))
             .otherwise(F.xxhash64("doc_id", F.lit("mix"))))
    return numbered.select(*KEY, "size", "number", place.alias("order"))


def _assign(counted: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST,
            schedules=SCHEDULES) -> DataFrame:
    sized = written(_numbered(counted), "numbered")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key")  # a null source is one too
    targets = source_targets(sized, weights, budget, most).select(key, "source_size", "rank", "target")
    # the order's leading bits are the bucket, so buckets are runs of the order
    keyed = sized.select("*", key, F.shiftrightunsigned("order", 65 - BUCKETS.bit_length()).alias("bucket"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (keyed.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
              .select("key", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("bucket_start"))
              .join(targets, "key"))
    ahead = (Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "text_hash", "number")
             .rowsBetween(Window.unboundedPreceding, -1))
    placed = (keyed.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
              .join(starts, ["key", "bucket"])
              .withColumn("begin", F.col("bucket_start") + F.col("ahead"))
              .withColumn("whole", F.round("target").cast("long")))
    # in epoch e, a source's words stand at e * source_size .. (e + 1) * source_size of its demand
    epochs = F.array(*[_one_copy(e, schedules) for e in range(math.ceil(most))])
    return (placed.withColumn("copies", F.filter(epochs, lambda c: c["words"] > 0))
            .select(*KEY, "number", "size", "source_size", "target",
                    F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken"),
                    "copies"))


def _one_copy(epoch: int, schedules) -> Column:
    begin = F.lit(epoch) * F.col("source_size") + F.col("begin")
    words = F.greatest(F.least(F.col("size"), F.col("whole") - begin), F.lit(0)).cast("long")
    share = F.least(begin / F.greatest(F.col("target"), F.lit(1.0)), F.lit(1.0))
    return F.struct(F.lit(epoch + 1).alias("copy"), words.alias("words"),
                    training_time(share, F.col("rank"), schedules).alias("position"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The training order: a row for each copy taken, with the document's columns, range-sorted by position.

    Adds ``mix_copy``, ``mix_words`` (the words of the text to train on, from its
    beginning) and ``mix_position`` (training time 0 .. 1).
    """
    clash = [c for c in docs.columns if c.lower().startswith("mix_")]
    if clash:
        raise ValueError(f"columns must not begin with mix_: {clash}")
    counted = _counted(docs)
    copies = _assign(counted, **settings).select(*KEY, "number", F.explode("copies").alias("mix"))
    copies = copies.select(*[F.col(c).alias(f"mix_{c}") for c in (*KEY, "number")], "mix")
    rows = _rows_numbered(docs, counted.where("rows > 1").select(*KEY))
    on = [rows["doc_id"].eqNullSafe(copies["mix_doc_id"]), rows["source"].eqNullSafe(copies["mix_source"]),
          rows["mix_hash"] == copies["mix_text_hash"], rows["mix_row"] == copies["mix_number"]]
    return (rows.join(copies, on)
            .select(*[rows[c] for c in docs.columns], F.col("mix.copy").alias("mix_copy"),
                    F.col("mix.words").alias("mix_words"), F.col("mix.position").alias("mix_position"))
            .orderBy("mix_position", "doc_id", "mix_copy"))


def _rows_numbered(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows with their text's hash and, among rows equal in ``KEY``, a number from 0 on.

    Only rows of ``repeated`` keys are numbered; a key's rows are numbered
    where they are stored, behind those of earlier parts, and not in one task.
    """
    rows = docs.withColumn("mix_hash", F.xxhash64("text"))
    if repeated.isEmpty():
        return rows.withColumn("mix_row", F.lit(0).cast("long"))
    keys = repeated.select(*[F.col(c).alias(f"mix_{c}") for c in KEY])
    on = [rows["doc_id"].eqNullSafe(keys["mix_doc_id"]), rows["source"].eqNullSafe(keys["mix_source"]),
          rows["mix_hash"] == keys["mix_text_hash"]]
    several = written(rows.join(keys, on, "left_semi").withColumn("mix_part", F.spark_partition_id())
                      .withColumn("mix_row", F.monotonically_increasing_id()), "repeated")
    key = ["doc_id", "source", "mix_hash"]
    before = Window.partitionBy(*key).orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (several.groupBy(*key, "mix_part").agg(F.count(F.lit(1)).alias("mix_n"))
              .select(*[F.col(c).alias(f"mix_key_{i}") for i, c in enumerate(key)], F.col("mix_part").alias("mix_at"),
                      F.coalesce(F.sum("mix_n").over(before), F.lit(0)).alias("mix_start")))
    inside = Window.partitionBy(*key, "mix_part").orderBy("mix_row")
    same = [several[c].eqNullSafe(starts[f"mix_key_{i}"]) for i, c in enumerate(key)]
    numbered = (several.withColumn("mix_row", F.row_number().over(inside).cast("long") - 1)
                .join(starts, [*same, several["mix_part"] == starts["mix_at"]])
                .select(*docs.columns, "mix_hash", (F.col("mix_row") + F.col("mix_start")).alias("mix_row")))
    return rows.join(keys, on, "left_anti").withColumn("mix_row", F.lit(0).cast("long")).unionByName(numbered)
