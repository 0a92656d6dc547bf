"""Benchmark decontamination by winnowed fingerprints.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z.  A
window is ``window`` consecutive words of a benchmark item; an item with fewer
words is one window of its own.  A document word is hit if it lies inside any
occurrence of a window.

Fingerprints: hash every ``gram`` consecutive words, and of each run of
``window - gram + 1`` such hashes keep the smallest (the rightmost of equal
ones).  Two texts that share ``window`` words share such a run, and so a kept
fingerprint at the same place in it.  Fingerprints of documents and items are
joined and extended word by word to both sides; a match of ``window`` words or
more is a hit.  Items below ``window`` words are joined by the hash of the
whole item.

A bit table of fixed size drops document fingerprints that no item has, before
anything leaves the task.  The join is left to the planner, which knows the
size of the written benchmark table: broadcast if small, else a shuffle with
skew handling.

Defined cases: null or empty text has no words; an item without words matches
nothing; an item_id that occurs twice is one item with both texts; a null
item_id reads as the empty string; each document row is judged on its own text,
whatever its doc_id; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import BitFilter, id_text, longs, map_arrow, written

WINDOW = 10
GRAM = 5
FILTER_BITS = 23  # 1 MB broadcast, whatever the benchmark


def winnow(w: W.Words, h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Positions of the kept ``gram``-word hashes of all documents with ``window`` words or more."""
    grams = W.windows(h, gram)
    runs = np.flatnonzero(w.left() >= window)
    span = window - gram + 1
    best, at = grams[runs], runs.copy()
    for j in range(1, span):
        other = grams[runs + j]
        lower = other <= best
        best = np.where(lower, other, best)
        at = np.where(lower, runs + j, at)
    return np.unique(at)


def _context(h: np.ndarray, w: W.Words, at: np.ndarray, gram: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes around each gram, nearest first: (positions x reach) on either side, 0 if outside."""
    d = w.doc_of_word()[at] if len(at) else at
    lo, hi = w.ptr[d][:, None], w.ptr[d + 1][:, None]
    steps = np.arange(reach)[None, :]
    sides = []
    for pos, inside in ((at[:, None] - 1 - steps, lambda p: p >= lo), (at[:, None] + gram + steps, lambda p: p < hi)):
        sides.append(np.where(inside(pos), h[np.clip(pos, 0, max(len(h) - 1, 0))], np.uint64(0)) if len(at)
                     else np.zeros((0, reach), np.uint64))
    return sides[0], sides[1]


def _rows(docs: np.ndarray, h: np.ndarray, w: W.Words, at: np.ndarray, fp: np.ndarray, size: int, reach: int) -> dict:
    left, right = _context(h, w, at, size, reach)
    return {"doc": docs, "fp": fp, "size": np.full(len(at), size, np.int32),
            "pos": (at - w.ptr[docs]).astype(np.int32) if len(at) else at.astype(np.int32),
            "near": np.hstack([left, right])}


def _joined(parts: list[dict], n_docs: int) -> tuple[dict, np.ndarray]:
    out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    order = np.argsort(out["doc"], kind="stable")
    out = {k: v[order] for k, v in out.items()}
    return out, np.searchsorted(out["doc"], np.arange(n_docs + 1))


_MARKS = "marks array<struct<fp:long,size:int,pos:int,near:array<long>>>"


def _marks(rows: dict, ptr: np.ndarray) -> pa.Array:
    n, width = rows["near"].shape
    near = W.list_column(rows["near"].reshape(-1).view(np.int64), np.arange(n + 1) * width, pa.int64())
    cells = pa.StructArray.from_arrays(
        [longs(rows["fp"]), pa.array(rows["size"], pa.int32()), pa.array(rows["pos"], pa.int32()), near],
        ["fp", "size", "pos", "near"])
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), cells)


def _item_marks(bench: DataFrame, window: int, gram: int) -> DataFrame:
    """(item, fp, size, pos, near): fingerprints of items, one for each item below ``window`` words."""
    reach = window - gram

    def emit(batch):
        for w in W.word_chunks(batch.column(1), W.ALNUM, lower=True):
            h = w.hashes()
            at = winnow(w, h, window, gram)
            parts = [_rows(w.doc_of_word()[at], h, w, at, W.windows(h, gram)[at], gram, reach)]
            for n in range(1, window):
                d = np.flatnonzero(w.counts == n)
                parts.append(_rows(d, h, w, w.ptr[d], W.windows(h, n)[w.ptr[d]] if len(d) else np.zeros(0, np.uint64),
                                   -n, reach))
            rows, ptr = _joined(parts, w.n_docs)
            yield {"item": batch.column(0).slice(w.first, w.n_docs), "marks": _marks(rows, ptr)}

    found = map_arrow(bench.select(id_text("item_id").alias("item"), "text"), emit, "item string, " + _MARKS)
    return found.select("item", F.explode("marks").alias("mark")).select("item", "mark.*").distinct()


def _document_marks(docs: DataFrame, known: BitFilter, sizes: list[int], window: int, gram: int) -> DataFrame:
    """Per document row: (doc_id, n_words, marks), the fingerprints that an item may have."""
    reach = window - gram

    def emit(batch):
        for w in W.word_chunks(batch.column(1), W.ALNUM, lower=True):
            h = w.hashes()
            at = winnow(w, h, window, gram)
            parts = []
            for size in [gram, *sizes]:
                n = abs(size)
                fps = W.windows(h, n)
                if size < 0:
                    at = np.flatnonzero(w.left() >= n)
                hit = at[known.hits(fps[at])]
                parts.append(_rows(w.doc_of_word()[hit], h, w, hit, fps[hit], size, reach))
            rows, ptr = _joined(parts, w.n_docs)
            yield {"doc_id": batch.column(0).slice(w.first, w.n_docs), "n_words": pa.array(w.counts.astype(np.int64)),
                   "marks": _marks(rows, ptr)}

    return map_arrow(docs.select("doc_id", "text"), emit, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
                     f"n_words long, {_MARKS}")


def _run_length(side: range):
    """How many of the words on one side agree, from the nearest outwards."""
    total, so_far = F.lit(0), F.lit(True)
    for i in side:
        a, b = F.col("near")[i], F.col("item_near")[i]
        so_far = so_far & (a == b) & (a != 0)
        total = total + so_far.cast("int")
    return total


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM,
                  filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): (row, doc_id, n_words) per input row, and (row, item, start, stop) word spans."""
    reach = window - gram
    items = written(_item_marks(bench, window, gram), "benchmark-marks")
    known = BitFilter(items, "fp", filter_bits)
    sizes = sorted(r["size"] for r in items.where("size < 0").select("size").distinct().collect())  # at most window - 1
    base = written(_document_marks(docs, known, sizes, window, gram)
                   .withColumn("row", F.monotonically_increasing_id()), "document-marks")
    marks = base.select("row", F.explode("marks").alias("mark")).select("row", "mark.*")
    met = marks.join(items.select("item", "fp", "size", F.col("near").alias("item_near")), ["fp", "size"])
    left, right = _run_length(range(reach)), _run_length(range(reach, 2 * reach))
    met = met.select("row", "item", "size", "pos", left.alias("l"), right.alias("r"))
    hits = met.where((F.col("size") < 0) | (F.col("l") + F.col("r") + gram >= window)).select(
        "row", "item",
        F.expr("if(size < 0, pos, pos - l)").alias("start"),
        F.expr(f"if(size < 0, pos - size, pos + {gram} + r)").alias("stop"))
    return base.select("row", "doc_id", "n_words"), hits


def decontaminate(docs: DataFrame, bench: DataFrame, **settings) -> DataFrame:
    """Per document row (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    from pyspark.sql import Window

    base, hits = contamination(docs, bench, **settings)
    hits = written(hits.distinct(), "hits")
    spans = hits.groupBy("row", "start").agg(F.max("stop").alias("stop"))
    ahead = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = (spans.withColumn("done", F.coalesce(F.max("stop").over(ahead), F.lit(0)))
               .groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "done")))
                                   .cast("long").alias("n_hit")))
    named = (hits.select("row", "item").distinct().groupBy("row")
             .agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item")).alias("items")))
    none = F.sha2(F.lit(""), 256)
    return (base.join(covered.join(named, "row"), "row", "left")
            .select("doc_id", "n_words",
                    F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                    F.coalesce(F.sha2(F.array_join("items", ","), 256), none).alias("items_sha256"),
                    F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated")))
