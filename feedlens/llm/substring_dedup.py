"""Removal of passages that an earlier document has too (difference-cover anchors).

Words are runs without ASCII white space.  A window is ``window`` consecutive
words of one document; every word covered by a window whose word sequence also
starts in a document with a smaller doc_id is removed.  Windows are judged on
the input.

Hashing every window would shuffle one row a word.  Instead, short anchors are
hashed only at positions whose remainder modulo a period lies in a difference
cover: for any two positions there is a shift below the period that brings both
onto the cover, so two equal windows always share an aligned anchor inside.
Anchors seen in two documents or more are extended to the windows around them;
these are then compared exactly, all over the corpus.  A document whose whole
word sequence equals an earlier document's is settled by that alone.

Defined cases: null or empty text has no words and keeps the hash of the empty
string; a document shorter than a window keeps everything; rows that repeat a
doc_id do not remove each other; a null doc_id is later than all others and
never removes from a document; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import BitFilter, longs, map_arrow, written

# Perfect difference sets: period -> positions.  Fixed values.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16),
          31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
WINDOW = 13
FILTER_BITS = 27  # 16 MB broadcast, whatever the data
COPY_BITS = 23    # 1 MB
_LAST = (1 << 63) - 1  # stands for a null doc_id


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of half a window, and its cover."""
    period = max(p for p in COVERS if p <= max(1, (window + 1) // 2))
    return period, COVERS[period]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)


def _anchors(w: W.Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and positions of the anchors that lie inside some window of their document."""
    period, cover = cover_for(window)
    length = window - period + 1
    place = np.arange(len(h)) - np.repeat(w.ptr[:-1], w.counts)
    fits = (w.left() >= length) & (np.repeat(w.counts, w.counts) >= window)
    marked = np.zeros(period, bool)
    marked[list(cover)] = True
    at = np.flatnonzero(fits & marked[place % period])
    return W.windows(h, length)[at], at, period


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), "text")


def shared_anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h): the anchor hashes that occur in two documents or more."""
    def emit(batch):
        for w in W.word_chunks(batch.column(1)):
            h, at, _ = _anchors(w, w.hashes(), window)
            v, _ = W.distinct_per_doc(h, w.doc_of_word()[at])
            yield {"h": longs(v)}  # once per document

    found = map_arrow(_prepared(docs), emit, "h long")
    return found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")


def _sequences(w: W.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each document's whole word sequence."""
    place = (np.arange(len(h)) - np.repeat(w.ptr[:-1], w.counts)).astype(np.uint64)
    out = []
    for salt in (101, 202):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(W.mix(h + W.mix(place + np.uint64(salt))), out=sums[1:])
        out.append(W.mix(sums[w.ptr[1:]] - sums[w.ptr[:-1]] + w.counts.astype(np.uint64)))
    return out[0], out[1]


def whole_copies(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(s1, s2, first): word sequences of at least a window that two documents or more have."""
    def emit(batch):
        ids = _ids(batch)
        for w in W.word_chunks(batch.column(1)):
            one, two = _sequences(w, w.hashes())
            long = w.counts >= window
            yield {"s1": longs(one[long]), "s2": longs(two[long]),
                   "doc_id": pa.array(ids[w.first:w.first + w.n_docs][long])}

    found = map_arrow(_prepared(docs), emit, "s1 long, s2 long, doc_id long")
    return (found.groupBy("s1", "s2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
            .where("first < last").select("s1", "s2", "first"))


def _digest(parts: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def _extended(w: W.Words, hashes: np.ndarray, shared: BitFilter, window: int):
    """The windows around shared anchors: first words, hashes, and their bounds per document."""
    a, at, period = _anchors(w, hashes, window)
    flags = np.zeros(len(hashes) + 1, np.int64)
    flags[at[shared.hits(a)] + 1] = 1
    seen = np.cumsum(flags)
    whole = np.flatnonzero(w.left() >= window)
    whole = whole[seen[whole + period] > seen[whole]]  # an anchor at shift 0 .. period - 1
    docs_of = w.doc_of_word()[whole]
    ptr = np.searchsorted(docs_of, np.arange(w.n_docs + 1))
    return (whole - w.ptr[docs_of]).astype(np.int32), W.windows(hashes, window)[whole], ptr


_FOUND = ("doc_id long, n_words long, whole_sha256 string, text string, s1 long, s2 long, "
          "starts array<int>, h array<long>")


def _candidates(docs: DataFrame, shared: BitFilter, copied: BitFilter, window: int) -> DataFrame:
    """Per document: its text and the windows around shared anchors; without any, its text is null.

    Documents that may be whole copies have their sequence's hashes (s1, s2) instead of windows.
    """
    def emit(batch):
        ids, texts = _ids(batch), batch.column(1)
        for w in W.word_chunks(texts):
            hashes = w.hashes()
            one, two = _sequences(w, hashes)
            maybe = copied.hits(one) & (w.counts >= window)
            starts, h, ptr = _extended(w, hashes, shared, window)
            use = ~np.repeat(maybe, np.diff(ptr))
            sizes = np.where(maybe, 0, np.diff(ptr))
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            some = maybe | (sizes > 0)
            shas = [None if s else _digest(w.data[o:e].tobytes().split())
                    for s, o, e in zip(some, w.offsets[:-1], w.offsets[1:])]
            yield {
                "doc_id": pa.array(ids[w.first:w.first + w.n_docs]),
                "n_words": pa.array(w.counts.astype(np.int64)),
                "whole_sha256": pa.array(shas, pa.string()),
                "text": texts.take(pa.array(np.arange(w.first, w.first + w.n_docs), mask=~some)),
                "s1": pa.array(one.view(np.int64), mask=~maybe), "s2": pa.array(two.view(np.int64), mask=~maybe),
                "starts": W.list_column(starts[use], bounds, pa.int32()),
                "h": W.list_column(h[use].view(np.int64), bounds, pa.int64()),
            }

    return map_arrow(_prepared(docs), emit, _FOUND)


def _late_candidates(rows: DataFrame, shared: BitFilter, window: int) -> DataFrame:
    """(row, doc_id, text, starts, h) of (row, doc_id, text)."""
    def emit(batch):
        for w in W.word_chunks(batch.column(2)):
            starts, h, ptr = _extended(w, w.hashes(), shared, window)
            yield {**{c: batch.column(i).slice(w.first, w.n_docs) for i, c in enumerate(("row", "doc_id", "text"))},
                   "starts": W.list_column(starts, ptr, pa.int32()),
                   "h": W.list_column(h.view(np.int64), ptr, pa.int64())}

    return map_arrow(rows.select("row", "doc_id", "text"), emit,
                     "row long, doc_id long, text string, starts array<int>, h array<long>")


def _cut(batch: pa.RecordBatch, window: int):
    """Removes the covered words of each text."""
    ids, texts, starts = (batch.column(i) for i in range(3))
    n_words, n_removed, kept, shas = [], [], [], []
    for text, at in zip(texts, starts):
        ws = text.as_py().encode().split()
        edge = np.zeros(len(ws) + 1, np.int64)
        if at.is_valid:
            at = at.values.to_numpy()
            edge[at] += 1  # starts are distinct
            edge[at + window] -= 1
        stay = np.cumsum(edge)[:-1] == 0
        left = b" ".join([x for x, s in zip(ws, stay) if s])
        n_words.append(len(ws))
        n_removed.append(int(len(ws) - stay.sum()))
        kept.append(left.decode() if n_removed[-1] else None)
        shas.append(hashlib.sha256(left).hexdigest())
    yield {"doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
           "kept_text": pa.array(kept, pa.string()), "kept_sha256": pa.array(shas, pa.string())}


_RESULT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def dedup_substrings(docs: DataFrame, window: int = WINDOW, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Per document row (doc_id, n_words, n_removed, kept_text, kept_sha256).

    ``kept_sha256`` is of the kept words joined by one space; ``kept_text`` is
    that text, or null where nothing was removed (the document stays as it is).
    """
    copies = written(whole_copies(docs, window), "copies")
    copied = BitFilter(copies, "s1", COPY_BITS)
    shared = BitFilter(shared_anchors(docs, window), "h", filter_bits)
    found = written(_candidates(docs, shared, copied, window)
                    .withColumn("row", F.monotonically_increasing_id()), "windows")

    # documents that may be copies: copies lose all words, the others are extended now
    maybe = (found.where("s1 is not null").join(copies, ["s1", "s2"], "left")
             .withColumn("is_copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))))
    late = written(_late_candidates(maybe.where("not is_copy"), shared, window), "late-windows")
    cands = found.where("s1 is null and text is not null").select("row", "doc_id", "text", "starts", "h").union(late)

    spread = (cands.select("row", "doc_id", F.explode(F.arrays_zip("starts", "h")).alias("w"))
              .select("row", "doc_id", F.col("w.starts").alias("start"), F.col("w.h").alias("h")))
    first = written(spread.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                    .where("lo < hi").select("h", "lo"), "first-windows")
    # both sides are plain exchanges, so a passage that very many documents share is split
    gone = (spread.join(first, "h").where("doc_id > lo")
            .groupBy("row").agg(F.collect_list("start").alias("at")))
    touched = cands.select("row", "doc_id", "text").join(gone, "row", "left")
    cut = map_arrow(touched.select("doc_id", "text", "at"), lambda b: _cut(b, window), _RESULT)
    nothing = F.lit(0).cast("long")
    whole = found.where("text is null").select(
        "doc_id", "n_words", nothing.alias("n_removed"),
        F.lit(None).cast("string").alias("kept_text"), F.col("whole_sha256").alias("kept_sha256"))
    emptied = maybe.where("is_copy").select(
        "doc_id", "n_words", F.col("n_words").alias("n_removed"),
        F.lit("").alias("kept_text"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    out = whole.unionByName(emptied).unionByName(cut)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(_LAST)))
