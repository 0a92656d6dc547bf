"""Ranked lexical search by presence masks, in integer arithmetic.

Every row of ``items`` is a query over all rows of ``docs``.  Terms are runs of
letters, digits and non-ASCII characters, A-Z in lower case.  With N documents
that have terms, L terms in all, n terms in a document, df documents that hold a
term and tf its occurrences in one, a document scores for an item the sum, over
the item's distinct terms, of

    floor(1000 ln((2N + 2) / (2 df + 1))) * (10**9 tf div (1000 tf + 20 m)),
    m = 50 + (50 n N) div L

Each item's ``top`` documents with a score above 0 are returned; equal scores
go by ascending doc_id.

Items are taken in blocks of about ``BLOCK_TERMS`` terms; a block is all that is
ever broadcast, and its documents are never shuffled.  For each block:

1. One pass over the texts keeps, of each document, its length and the terms it
   shares with the block, as a written table; N, L and df are aggregates of it.
2. One pass over that table ranks in each task.  A batch of documents is held as
   a bitmap per term.  An item's documents are grouped by the mask of its terms
   that they hold; a mask's greatest possible score is the sum of its terms'
   greatest contributions in the batch.  Masks are scored by descending
   possible score, and finished when the ``top`` documents found so far in the
   task all score more than any mask left could: no result is lost.
3. The tasks' best documents are ranked, first in groups of tasks, then over
   all, so that no task sees more than ``top`` rows of each of some tasks.

Long items and texts are taken whole.  64-bit hashes stand for the terms.

Defined cases: null and empty texts have no terms, are found by nothing and
find nothing; without documents there are no results; every row is an item or a
document by itself, so that repeated rows rank one after the other (ties go by
doc_id, null last) and equal item_ids each have a ranking; null ids stay null;
only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import map_arrow, written

TOP = 50
BLOCK_TERMS = 1 << 16
# Cells (terms x documents) of the contributions that a task holds at once
CELLS = 1 << 22
# Documents scored, in whole masks, before the threshold is looked at again
_STEP = 256
# Groups of tasks whose best documents are ranked before all are
_TASK_GROUPS = 64


@dataclass
class Block:
    """Some items: the distinct terms of all, and the places of each item's terms among them."""

    hashes: np.ndarray         # sorted
    terms: list[np.ndarray]    # of each item
    ids: list                  # item_id of each item


def blocks(items: DataFrame, limit: int = BLOCK_TERMS) -> Iterator[Block]:
    """The items in blocks of at most ``limit`` terms or of one item; the driver holds one block at a time."""
    def emit(batch):
        for w in W.word_chunks(batch.column(1), W.ALNUM, lower=True):
            value, doc = W.distinct_per_doc(w.hashes(), w.doc_of_word())
            ptr = np.searchsorted(doc, np.arange(w.n_docs + 1))
            yield {"item_id": batch.column(0).slice(w.first, w.n_docs),
                   "terms": W.list_column(value.view(np.int64), ptr, pa.int64())}

    kind = items.schema["item_id"].dataType.simpleString()
    rows = map_arrow(items.select("item_id", "text"), emit, f"item_id {kind}, terms array<bigint>")
    held, ids, size = [], [], 0

    def block():
        value, place = np.unique(np.concatenate(held), return_inverse=True)
        return Block(value, np.split(place, np.cumsum([len(h) for h in held])[:-1]), list(ids))

    for r in rows.where(F.size("terms") > 0).toLocalIterator():
        if held and size + len(r["terms"]) > limit:
            yield block()
            held, ids, size = [], [], 0
        held.append(np.array(r["terms"], np.int64).view(np.uint64))
        ids.append(r["item_id"])
        size += len(r["terms"])
    if held:
        yield block()


def postings(docs: DataFrame, shared) -> DataFrame:
    """Per document row: doc_id, n, and place and tf of its terms that the block has."""
    def emit(batch):
        known = shared.value.hashes
        for w in W.word_chunks(batch.column(1), W.ALNUM, lower=True):
            h = w.hashes()
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            key, tf = np.unique(w.doc_of_word()[hit] * len(known) + at[hit], return_counts=True)
            ptr = np.searchsorted(key, np.arange(w.n_docs + 1) * len(known))
            yield {"doc_id": batch.column(0).slice(w.first, w.n_docs), "n": pa.array(w.counts.astype(np.int64)),
                   "terms": W.list_column(key % len(known), ptr, pa.int32()),
                   "tf": W.list_column(tf, ptr, pa.int64())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), emit,
                     f"doc_id {kind}, n bigint, terms array<int>, tf array<bigint>")


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """The weight of each term, from the documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Ranking:
    """An item's best documents of a task so far: scores, descending, and rows of a list that the task keeps."""

    def __init__(self, top: int):
        self.top = top
        self.scores, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must reach to be among them."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, rows: np.ndarray, place: np.ndarray) -> None:
        """``place`` orders the rows that the task has seen, for equal scores."""
        scores, rows = np.concatenate([self.scores, scores]), np.concatenate([self.rows, rows])
        order = np.lexsort((place[rows], -scores))[:self.top]
        self.scores, self.rows = scores[order], rows[order]


def mask_groups(present: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by their mask, masks by descending greatest score.

    ``present`` has a row for each term and a column for each document,
    ``most`` each term's greatest contribution.  Returns the documents, the
    bounds of each mask's among them, and the masks' greatest scores.
    """
    bits = np.packbits(present, axis=0).T
    wide = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
    wide[:, :bits.shape[1]] = bits
    # a mask of up to 64 terms is one number, a longer one a row of them
    mask = wide.view(np.uint64)
    order = np.lexsort(mask.T)
    mask = mask[order]
    first = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]).any(axis=1)))
    possible = most @ present[:, order[first]]
    rank = np.argsort(-possible, kind="stable")
    bounds = np.append(first, len(order))
    sizes = np.diff(bounds)[rank]
    ends = np.cumsum(sizes)
    docs = order[np.repeat(bounds[:-1][rank] - ends + sizes, sizes) + np.arange(len(order))]
    return docs, np.append(0, ends), possible[rank]


def rank_batch(part: np.ndarray, present: np.ndarray, rows: np.ndarray, place: np.ndarray, ranking: Ranking) -> int:
    """Scores a batch's documents for an item, mask by mask; returns how many were scored.

    ``part`` holds the contribution of each of the item's terms (rows) to each
    document (columns), ``rows`` the documents' rows in the task's list.
    """
    most = part.max(axis=1)
    if int(most.sum()) < ranking.least:
        return 0
    docs, bounds, possible = mask_groups(present, most)
    done = 0
    while done < len(possible) and possible[done] >= ranking.least:
        # the masks that may still matter, some at a time
        upto = min(max(done + 1, int(np.searchsorted(bounds, bounds[done] + _STEP))),
                   int(np.searchsorted(-possible, -ranking.least, side="right")))
        some = docs[bounds[done]:bounds[upto]]
        scores = part[:, some].sum(axis=0)
        good = scores >= ranking.least
        if good.any():
            ranking.add(scores[good], rows[some[good]], place)
        done = upto
    return int(bounds[done])


def _ranked(table: DataFrame, shared, stats, top: int) -> DataFrame:
    """(item, doc_id, score): the best documents of each task."""
    id_type = table.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (n_docs, n_terms, weight) = shared.value, stats.value
        rankings, ids, seen = [Ranking(top) for _ in block.terms], [], 0
        held = max(64, CELLS // len(block.hashes))
        for whole in batches:
            for begin in range(0, whole.num_rows, held):
                batch = whole.slice(begin, held)
                size, n = batch.num_rows, batch.column(1).to_numpy()
                lists = batch.column(2)
                at, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
                doc = np.repeat(np.arange(size), pc.list_value_length(lists).to_numpy())
                # 50 n N div L without a product beyond 64 bits
                whole_part, rest = np.divmod(n * n_docs, n_terms)
                m = 50 + 50 * whole_part + 50 * rest // n_terms
                present = np.zeros((len(block.hashes), size), bool)
                part = np.zeros((len(block.hashes), size), np.int64)
                present[at, doc] = True
                part[at, doc] = weight[at] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                ids.append(batch.column(0))
                # ties: ids ascending, null last, then the order of the rows
                everything = pa.chunked_array(ids).combine_chunks()
                order = pc.sort_indices(everything, null_placement="at_end").to_numpy()
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                rows = np.arange(seen, seen + size)
                for terms, ranking in zip(block.terms, rankings):
                    rank_batch(part[terms], present[terms], rows, place, ranking)
                # only documents of a ranking are kept
                kept = np.unique(np.concatenate([r.rows for r in rankings]))
                for r in rankings:
                    r.rows = np.searchsorted(kept, r.rows)
                ids, seen = [everything.take(pa.array(kept))], len(kept)
        if ids:
            item = np.repeat(np.arange(len(rankings)), [len(r.rows) for r in rankings])
            yield pa.RecordBatch.from_pydict({
                "item": pa.array(item, pa.int32()), "doc_id": ids[0].take(pa.array(np.concatenate([r.rows for r in rankings]))),
                "score": pa.array(np.concatenate([r.scores for r in rankings]))})

    return table.mapInArrow(run, f"item int, doc_id {id_type}, score bigint")


def _best(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, block: Block, id_type: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(block)
    table = written(postings(docs, shared), "postings")
    total = table.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    df = np.zeros(len(block.hashes), np.int64)
    # at most one row for each of the block's terms
    for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[r["t"]] = r["count"]
    n_docs, n_terms = total["docs"], max(total["terms"] or 0, 1)
    stats = spark.sparkContext.broadcast((n_docs, n_terms, weights(df, n_docs)))
    found = _ranked(table, shared, stats, top).withColumn("tasks", F.spark_partition_id() % _TASK_GROUPS)
    best = _best(_best(found, ["item", "tasks"], top).drop("rank"), ["item"], top)
    names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {id_type}")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Per item its best documents: (item_id, rank from 1, doc_id, score)."""
    item_type, doc_type = (d.schema[c].dataType.simpleString() for d, c in ((items, "item_id"), (docs, "doc_id")))
    parts = [_search_block(docs, b, item_type, top) for b in blocks(items, block_terms)]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id {doc_type}, score bigint")
    return reduce(DataFrame.unionAll, parts)
