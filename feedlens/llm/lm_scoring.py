"""Language-model scoring: a gated recurrent network over words, with exact corpus counts below it.

Tokens are a text's words (runs without ASCII white space, A-Z lower-cased)
and one end.  Documents whose crc32(doc_id as text) mod 5 is ``HELD_FOLD`` are
held out of everything learned.

Counts: every training word is counted, in the whole corpus.  The ``HEAD`` most
frequent tokens that occur twice or more are the network's vocabulary, in
classes by frequency.  All other words, seen or not, belong to one of ``REST``
classes by their spelling (words seen once teach the network how often those occur);
the network predicts the class, and the counts the word in it:
(c + 0.5) / (N + 0.5 (V + 1)) over the class's training words, so that a text's
probability never lacks a word.

Training: each of ``ROUNDS`` rounds takes its share of all training documents.
In a round every task starts from the round's parameters, trains on whole
documents by truncated back-propagation, and the tasks' parameters are
averaged, weighted by tokens.  The first round starts from the counts.

Scoring carries the state from a document's first token to its last.  Counts
of the ``KNOWN`` most frequent words are broadcast (4 MB); rarer words go
through a join with the count table.

Defined cases: null and empty texts are one token, the end; rows that repeat a
doc_id are counted and scored each; a null doc_id reads as the empty string in
the fold; without training documents every count is 0 and the network knows
the end only; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from . import words as W
from .tables import crc_fold, longs, map_arrow, shuffles_dropped, written

HELD_FOLD = 1
HEAD = 32_768   # the end and the most frequent words, in gru.CLASSES classes
HEAD_TIMES = 2  # a word of the head occurs so often: words seen once train the rest classes for unseen ones
REST = 8
KNOWN = 262_144
ROUNDS = 2
TRAIN_BYTES = 4 << 20  # text that one set of lanes holds
TASK_BYTES = 16 << 20  # training text that one task has at least: each task sends all parameters
BLOCK = 8192           # parameters in a row while they are averaged
SPREAD = 64            # partial averages of a block
_U = np.uint64


def _punctuated() -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(b".,;:!?\"')]}")] = True
    return t


_PUNCT = _punctuated()


def rest_class(w: W.Words) -> np.ndarray:
    """A class of each word by spelling: any non-ASCII letter, punctuation at the end, length."""
    if not len(w.starts):
        return np.zeros(0, np.int64)
    high = np.concatenate([[0], np.cumsum(w.data >= 0x80)])
    return (4 * (high[w.ends] > high[w.starts]) + 2 * _PUNCT[w.data[w.ends - 1]]
            + (w.ends - w.starts > 7)).astype(np.int64)


def _selected(docs: DataFrame, condition) -> DataFrame:
    return docs.where(condition).select("text")


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, kind, n): hash, spelling class and count of every training word."""
    def emit(batch):
        hashes, kinds, counts = [], [], []
        for w in W.word_chunks(batch.column(0), lower=True):
            h, first, n = np.unique(w.hashes(), return_index=True, return_counts=True)
            hashes.append(h)
            kinds.append(rest_class(w)[first])
            counts.append(n)
        h, first, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        n = np.bincount(place, weights=np.concatenate(counts), minlength=len(h)).astype(np.int64)
        yield {"h": longs(h), "kind": pa.array(np.concatenate(kinds)[first].astype(np.int32)), "n": pa.array(n)}

    rows = map_arrow(_selected(docs, crc_fold("doc_id") != HELD_FOLD), emit, "h long, kind int, n long")
    return rows.groupBy("h").agg(F.min("kind").alias("kind"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every task knows of the counts; sizes do not depend on the corpus."""

    head: np.ndarray        # sorted hashes of the head words
    head_id: np.ndarray     # their ids; 0 is the end
    known: np.ndarray       # sorted hashes of the most frequent words
    known_n: np.ndarray     # their counts
    n_ends: int             # count of the end: training documents
    total: int              # N
    types: int              # V
    rest_total: np.ndarray  # N and V of each rest class
    rest_types: np.ndarray
    n_head: int             # ids of head tokens
    starts: np.ndarray      # their classes

    def base(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.types + 1)))

    def ids(self, h: np.ndarray, kind: np.ndarray) -> np.ndarray:
        if not len(self.head):
            return self.n_head + kind
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return np.where(self.head[at] == h, self.head_id[at], self.n_head + kind)


def vocabulary(counts: DataFrame, n_ends: int) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the counts of the head tokens."""
    top = counts.orderBy(F.desc("n"), "h").limit(KNOWN).toArrow()
    h, n, kind = top["h"].to_numpy().view(_U), top["n"].to_numpy(), top["kind"].to_numpy()
    n_head_words = min(HEAD - 1, int((n >= HEAD_TIMES).sum()))
    order, known = np.argsort(h[:n_head_words]), np.argsort(h)
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()}
    rest_n = np.array([sums[k]["n"] if k in sums else 0 for k in range(REST)], float)
    rest_v = np.array([sums[k]["types"] if k in sums else 0 for k in range(REST)], float)
    total, types = int(rest_n.sum()) + n_ends, int(rest_v.sum()) + (n_ends > 0)
    rest_n -= np.bincount(kind[:n_head_words], weights=n[:n_head_words], minlength=REST)
    rest_v -= np.bincount(kind[:n_head_words], minlength=REST)
    head_counts = np.concatenate([[n_ends], n[:n_head_words]]).astype(float)
    return Vocabulary(h[:n_head_words][order], order + 1, h[known], n[known], n_ends, total, types,
                      rest_n, rest_v, len(head_counts), gru.class_starts(head_counts)), head_counts


def _tokens(w: W.Words, h: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of each document, ends included, and their bounds."""
    ptr = w.ptr + np.arange(len(w.ptr))
    ids = np.zeros(ptr[-1], np.int32)
    is_word = np.ones(len(ids), bool)
    is_word[ptr[1:] - 1] = False
    ids[is_word] = v.ids(h, rest_class(w))
    return ids, ptr


def _trained(docs: DataFrame, v, start, turn: int, n_tasks: int) -> DataFrame:
    """(block, part, weight, values): each task's parameters after its documents of this round.

    The files' partitions are put together where they are more than ``n_tasks``.
    """
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == turn
    rows = _selected(docs, (crc_fold("doc_id") != HELD_FOLD) & share).coalesce(n_tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params = {k: a.copy() for k, a in start.value.items()}
        model, squares, weight = gru.Model(params, v.value.starts), {k: np.full_like(a, 1e-8) for k, a in params.items()}, 0
        for batch in batches:
            for w in W.word_chunks(batch.column(0), lower=True, limit=TRAIN_BYTES):
                ids, ptr = _tokens(w, w.hashes(), v.value)
                model.train(ids, ptr, squares)
                weight += len(ids)
        if weight:
            values = gru.flat(params)
            cuts = np.append(np.arange(0, len(values), BLOCK), len(values))
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(np.arange(len(cuts) - 1), pa.int32()),
                "weight": pa.array(np.full(len(cuts) - 1, float(weight))),
                "values": W.list_column(values * float(weight), cuts, pa.float32())})
        W.release()

    return rows.mapInArrow(run, "block int, weight double, values array<float>").withColumn(
        "part", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))



def _averaged(rows: DataFrame, like: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
    """The weighted mean of the tasks' parameters, summed in two steps."""
    def add(table: pa.Table) -> pa.Table:
        lists = table["values"].combine_chunks()
        values = np.stack(lists.to_numpy(zero_copy_only=False)).astype(np.float64).sum(axis=0)
        return pa.table({"block": table["block"].slice(0, 1).cast(pa.int32()),
                         "weight": pa.array([sum(table["weight"].to_pylist())], pa.float64()),
                         "values": pa.array([values.astype(np.float32)], pa.list_(pa.float32()))})

    schema = "block int, weight double, values array<float>"
    partial = rows.groupBy("block", "part").applyInArrow(lambda t: add(t), schema)
    with shuffles_dropped(rows.sparkSession):
        got = partial.groupBy("block").applyInArrow(lambda t: add(t), schema).orderBy("block").toArrow()
    if not got.num_rows:
        return None
    weight = got["weight"].to_numpy()
    values = [np.array(x, np.float64) / n for x, n in zip(got["values"].to_pylist(), weight)]
    return gru.unflat(np.concatenate(values), like)


def train(docs: DataFrame, v: Vocabulary, head_counts: np.ndarray, n_bytes: int) -> dict[str, np.ndarray]:
    """The parameters after all rounds; ``n_bytes``: size of the training text."""
    spark, n_tasks = docs.sparkSession, 1 + n_bytes // TASK_BYTES
    params, shared = gru.initial(head_counts, np.maximum(v.rest_total, 0)), spark.sparkContext.broadcast(v)
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(params)
        params = _averaged(_trained(docs, shared, start, turn, n_tasks), params) or params
    return params


def _document_scores(docs: DataFrame, v: Vocabulary, params: dict[str, np.ndarray]) -> DataFrame:
    """Per document row: what the network and the broadcast counts give, and its other words (tail, times)."""
    shared = docs.sparkSession.sparkContext.broadcast((v, params))
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, counted double, "
              "network double, tail array<long>, times array<int>")

    def emit(batch):
        v, params = shared.value
        model = gru.Model(params, v.starts)
        # a rest word's probability in its class is (c + 0.5) / (N + 0.5 (V + 1))
        norm = np.log10(v.rest_total + 0.5 * (v.rest_types + 1))
        end = np.log10(v.n_ends + 0.5)
        for w in W.word_chunks(batch.column(1), lower=True, limit=TRAIN_BYTES):
            h, owner, n = w.hashes(), w.doc_of_word(), w.n_docs
            ids, ptr = _tokens(w, h, v)
            at = np.minimum(np.searchsorted(v.known, h), max(len(v.known) - 1, 0))
            known = v.known[at] == h if len(v.known) else np.zeros(len(h), bool)
            logs = np.zeros(len(h))
            logs[known] = np.log10(v.known_n[at[known]] + 0.5)
            word_ids = np.delete(ids, ptr[1:] - 1)
            rest = word_ids >= v.n_head
            network = model.score(ids, ptr) / np.log(10)
            network -= np.bincount(owner[rest], weights=norm[word_ids[rest] - v.n_head], minlength=n)
            network += np.bincount(owner[rest], weights=logs[rest], minlength=n)
            tail, d = h[~known], owner[~known]
            order = W.order_within(tail, d)
            tail, d = tail[order], d[order]
            fresh = np.ones(len(tail), bool)
            fresh[1:] = (tail[1:] != tail[:-1]) | (d[1:] != d[:-1])
            first = np.flatnonzero(fresh)
            bounds = np.searchsorted(d[first], np.arange(n + 1))
            yield {"doc_id": batch.column(0).slice(w.first, n), "n_tokens": pa.array((w.counts + 1).astype(np.int64)),
                   "n_known": pa.array((np.bincount(owner[known], minlength=n) + (v.n_ends > 0)).astype(np.int64)),
                   "counted": pa.array(np.bincount(owner, weights=logs, minlength=n) + end),
                   "network": pa.array(network),
                   "tail": W.list_column(tail[first].view(np.int64), bounds, pa.int64()),
                   "times": W.list_column(np.diff(np.append(first, len(tail))).astype(np.int32), bounds, pa.int32())}

    return map_arrow(docs.select("doc_id", "text"), emit, schema)


def score_documents(docs: DataFrame) -> DataFrame:
    """Per document row (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    counts = written(word_counts(docs), "word-counts")
    n_ends, n_bytes = docs.where(crc_fold("doc_id") != HELD_FOLD).agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    v, head_counts = vocabulary(counts, n_ends)
    params = train(docs, v, head_counts, n_bytes)
    scored = written(_document_scores(docs, v, params)
                     .withColumn("row", F.monotonically_increasing_id()), "document-scores")
    tail = (scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("w"))
            .select("row", F.col("w.tail").alias("h"), F.col("w.times").alias("times"))
            .join(counts.select("h", "n"), "h", "left")
            .groupBy("row").agg(
                F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("tail_counted"),
                F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("tail_known")))
    more, known = F.coalesce("tail_counted", F.lit(0.0)), F.coalesce("tail_known", F.lit(0).cast("long"))
    return scored.join(tail, "row", "left").select(
        "doc_id", (crc_fold("doc_id") == HELD_FOLD).alias("held_out"), "n_tokens",
        (F.col("n_known") + known).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("counted") + more - F.col("n_tokens") * F.lit(v.base())).alias("base_score"),
        (F.col("network") + more).alias("score"))
