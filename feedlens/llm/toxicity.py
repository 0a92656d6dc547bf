"""Toxicity: gradient-boosted trees over dense text features, calibrated.

Features of a text: densities of a lexicon, how near its hits are to words of
the second person, shares of capitals, shouting and punctuation, rates of
obfuscated words, and length.  The model is fitted on a bounded sample:
``MAX_FIT_ROWS`` labelled training rows, the first in the order of a hash of
doc_id.  Its lexicon holds words, and word beginnings of 4 to 6 bytes, that the
sample's texts labelled toxic have in many different contexts and others hardly
ever.  (Contexts, so that the rare words of one much-copied text do not
qualify.)  A fifth of the sample calibrates the trees.

The sample's labels are broadcast (at most ``MAX_FIT_ROWS`` rows), so that no
text is shuffled; scoring is one pass over all documents.

Rows whose crc32(doc_id as text) mod 5 is 0 are held out of lexicon, trees and
calibration.  Labels, lang, source and doc_id are no inputs of a score.

Defined cases: null and empty texts have all features 0 and a score like any
other; rows that repeat a doc_id are scored each; labels that are null, or for
unknown documents, are ignored, and a doc_id labelled twice counts as toxic if
either label says so; without labels of both kinds every score is the share of
toxic labels (0 without any); other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import crc_fold, longs, map_arrow, written
from .trees import BoostedTrees, Isotonic

MAX_FIT_ROWS = 20_000
MAX_CANDIDATES = 65_536  # lexicon candidates that are looked at in context: 0.5 MB broadcast
MAX_LEXICON = 8_192
MIN_DOCS = 4       # toxic training documents that have a candidate
MIN_CONTEXTS = 4   # different contexts of a lexicon entry in toxic training documents
MIN_ODDS = 12.0    # how much more frequent it is in them
PREFIXES = (4, 5, 6)
NEAR = 4

# Second-person words (fixed values), English, German, French, Spanish.
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine euch euer ihr sie tu toi te vous votre vos "
                 "ton ta tes usted ustedes ti tú te vosotros").split()

FEATURES = ("lexicon_density", "lexicon_weight", "lexicon_hits", "prefix_density", "second_density",
            "hit_near_second", "capital_share", "shout_share", "exclaim_rate", "punct_rate",
            "obfuscated_share", "stretched_share", "word_length", "log_words")

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[0x41:0x5B] = _ALPHA[0x61:0x7B] = _ALPHA[0x80:] = True
_INNER = np.zeros(256, bool)  # digits and signs that stand for letters
_INNER[list(b"0123456789@$*!#")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!\"'(),-./:;?")] = True


def _entries(w: W.Words) -> np.ndarray:
    """Hashes of each word and of its beginnings (words x 4); a short word's beginnings are itself."""
    h = w.hashes()
    cols = [h]
    for n in PREFIXES:
        cut = W.Words(w.data, w.offsets, w.starts, np.minimum(w.starts + n, w.ends), w.ptr, w.first)
        longer = (w.ends - w.starts) > n
        cols.append(np.where(longer, W.mix(cut.hashes() + np.uint64(n)), h))
    return np.stack(cols, axis=1)


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of the labelled training rows that the model is fitted on."""
    chosen = written(
        labels.where("toxic is not null and doc_id is not null").where(crc_fold("doc_id") != 0)
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "labels")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _candidates(train: DataFrame) -> DataFrame:
    """(h, pos, neg): in how many toxic and other training documents each entry occurs."""
    def emit(batch):
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for w in W.word_chunks(batch.column(0), W.ALNUM, lower=True):
            e = _entries(w)
            v, d = W.distinct_per_doc(e.reshape(-1), np.repeat(w.doc_of_word(), e.shape[1]))
            bad = toxic[w.first + d] > 0
            values, place = np.unique(v, return_inverse=True)
            pos = np.bincount(place, weights=bad, minlength=len(values)).astype(np.int64)
            yield {"h": longs(values), "pos": pa.array(pos),
                   "neg": pa.array(np.bincount(place, minlength=len(values)) - pos)}

    return (map_arrow(train, emit, "h long, pos long, neg long")
            .groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))


def _contexts(train: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(h, pos, neg): in how many different contexts (word before, word, word after) entries occur."""
    shared = train.sparkSession.sparkContext.broadcast(np.sort(wanted))

    def emit(batch):
        toxic, known = batch.column(1).to_numpy(zero_copy_only=False), shared.value
        for w in W.word_chunks(batch.column(0), W.ALNUM, lower=True):
            e = _entries(w)
            h = np.concatenate([[np.uint64(0)], e[:, 0], [np.uint64(0)]])
            around = W.mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7))
            at = np.searchsorted(known, e)
            row, col = np.nonzero(known[np.minimum(at, len(known) - 1)] == e)
            pairs, first = np.unique(np.stack([e[row, col], around[row]], axis=1), axis=0, return_index=True)
            yield {"h": longs(np.ascontiguousarray(pairs[:, 0])), "c": longs(np.ascontiguousarray(pairs[:, 1])),
                   "bad": pa.array((toxic[w.first + w.doc_of_word()[row[first]]] > 0).astype(np.int32))}

    return (map_arrow(train, emit, "h long, c long, bad int")
            .groupBy("h", "c").agg(F.max("bad").alias("bad"))
            .groupBy("h").agg(F.sum("bad").alias("pos"), F.sum(1 - F.col("bad")).alias("neg")))


def learn_lexicon(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted entry hashes and their weights (log odds ratios)."""
    n = {r["toxic"] > 0: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return np.zeros(0, np.uint64), np.zeros(0)
    ratio = n[False] / n[True]
    found = (_candidates(train).withColumn("odds", F.expr(f"(pos + 0.5) / (neg + 0.5) * {ratio!r}"))
             .where((F.col("pos") >= MIN_DOCS) & (F.col("odds") >= MIN_ODDS))
             .orderBy((F.log("odds") * F.log1p("pos")).desc(), "h").limit(MAX_CANDIDATES).select("h").toArrow())
    if not found.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0)
    kept = (_contexts(train, found["h"].to_numpy().view(np.uint64))
            .withColumn("odds", F.expr(f"(pos + 0.5) / (neg + 0.5) * {ratio!r}"))
            .where((F.col("pos") >= MIN_CONTEXTS) & (F.col("odds") >= MIN_ODDS))
            .orderBy((F.log("odds") * F.log1p("pos")).desc(), "h").limit(MAX_LEXICON).select("h", F.log("odds").alias("weight")).toArrow())
    h = kept["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], kept["weight"].to_numpy()[order]


def _per_doc(w: W.Words, value: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    return sums[w.ptr[1:]] - sums[w.ptr[:-1]]


def features(w_plain: W.Words, w: W.Words, lexicon: tuple[np.ndarray, np.ndarray], second: np.ndarray) -> np.ndarray:
    """(documents x FEATURES) of one chunk: its white-space words and its lower-cased ones."""
    known, weight = lexicon
    n = np.maximum(w.counts, 1)
    e = _entries(w)
    if len(known) and len(e):
        at = np.minimum(np.searchsorted(known, e), len(known) - 1)
        found = known[at] == e
        gain = np.where(found, weight[at], 0.0)
    else:
        found, gain = np.zeros(e.shape, bool), np.zeros(e.shape)
    hit, strong = found.any(axis=1), gain.max(axis=1, initial=0.0)
    you = np.isin(e[:, 0], second)
    mark = np.concatenate([[0], np.cumsum(you)])
    i, owner = np.arange(len(hit)), w.doc_of_word()
    near = mark[np.minimum(i + NEAR + 1, w.ptr[1:][owner])] - mark[np.maximum(i - NEAR, w.ptr[:-1][owner])] > 0

    def share(table):  # bytes of a table, per document and per word
        s = np.concatenate([[0], np.cumsum(table[w_plain.data])])
        return s[w_plain.offsets[1:]] - s[w_plain.offsets[:-1]], s[w_plain.ends] - s[w_plain.starts]

    upper, word_upper = share(_UPPER)
    alpha, word_alpha = share(_ALPHA)
    _, word_inner = share(_INNER)
    punct, _ = share(_PUNCT)
    bang, _ = share(_BANG)
    size = w_plain.ends - w_plain.starts
    ends_inner = _INNER[w_plain.data[w_plain.ends - 1]] if len(size) else size
    starts_inner = _INNER[w_plain.data[w_plain.starts]] if len(size) else size
    inside = word_inner - ends_inner.astype(int) - starts_inner.astype(int)
    obfuscated = (inside > 0) & (word_alpha >= 2)
    shouting = (word_upper == size) & (size > 2)
    same = np.zeros(len(w_plain.data) + 1, np.int64)
    if len(w_plain.data) > 2:
        d = w_plain.data
        same[3:] = np.cumsum((d[2:] == d[1:-1]) & (d[1:-1] == d[:-2]) & _ALPHA[d[2:]])
    stretched = same[w_plain.ends] - same[np.minimum(w_plain.starts + 2, w_plain.ends)] > 0
    m = np.maximum(w_plain.counts, 1)
    length = np.maximum(np.diff(w_plain.offsets), 1)
    hits = _per_doc(w, hit)
    return np.stack([
        hits / n, _per_doc(w, strong) / n, np.log1p(hits), _per_doc(w, found[:, 1:].any(axis=1) & ~found[:, 0]) / n,
        _per_doc(w, you) / n, _per_doc(w, hit & near) / n, upper / np.maximum(alpha, 1),
        _per_doc(w_plain, shouting) / m, bang / m, punct / length, _per_doc(w_plain, obfuscated) / m,
        _per_doc(w_plain, stretched) / m, _per_doc(w_plain, size) / m, np.log1p(w_plain.counts),
    ], axis=1)


_BANG = np.zeros(256, bool)
_BANG[list(b"!?")] = True


def _second_person() -> np.ndarray:
    return np.concatenate([w.hashes() for w in W.word_chunks(pa.array(SECOND_PERSON), W.ALNUM, lower=True)])


def _feature_chunks(texts: pa.Array, lexicon, second):
    plain = W.word_chunks(texts)
    lowered = W.word_chunks(texts, W.ALNUM, lower=True)
    for p, w in zip(plain, lowered):  # chunks depend on the bytes alone, so they go together
        yield p.first, p.n_docs, features(p, w, lexicon, second)


class Model:
    """Lexicon, trees and calibration; without both labels, a constant."""

    def __init__(self, constant: float, lexicon=None, trees: BoostedTrees | None = None,
                 calibration: Isotonic | None = None):
        self.constant, self.lexicon, self.trees, self.calibration = constant, lexicon, trees, calibration

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.constant)
        return np.clip(self.calibration(self.trees.raw(x)), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Model:
    """Lexicon, trees and calibration from the ``max_rows`` first labelled training rows by hash of doc_id."""
    # read four times; written, so that the documents are read once for it
    spark, sample = docs.sparkSession, written(_sample(docs, labels, max_rows), "fit-sample")
    lexicon = learn_lexicon(sample)
    shared, second = spark.sparkContext.broadcast(lexicon), _second_person()

    def emit(batch):
        toxic = pa.array(batch.column(1))
        for first, n, x in _feature_chunks(batch.column(0), shared.value, second):
            yield {"toxic": toxic.slice(first, n), "x": W.list_column(
                x.reshape(-1), np.arange(n + 1) * x.shape[1], pa.float64())}

    rows = map_arrow(sample, emit, "toxic int, x array<double>").toArrow()
    y = rows["toxic"].to_numpy().astype(float) > 0
    if len(y) == 0 or y.all() or not y.any():
        return Model(float(y.mean()) if len(y) else 0.0)
    x = np.stack(rows["x"].to_numpy())
    # rows arrive in any order: a fixed one makes reruns agree
    order = np.lexsort(np.column_stack([x, y]).T)
    x, y = x[order], y[order].astype(float)
    calibrate = np.arange(len(y)) % 5 == 4
    if y[calibrate].sum() in (0, calibrate.sum()) or y[~calibrate].sum() in (0, (~calibrate).sum()):
        calibrate = np.zeros(len(y), bool)
    trees = BoostedTrees().fit(x[~calibrate], y[~calibrate])
    part = calibrate if calibrate.any() else ~calibrate
    return Model(float(y.mean()), lexicon, trees, Isotonic.fit(trees.raw(x[part]), y[part]))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """Per document row (doc_id, held_out, score, predicted)."""
    model = fit(docs, labels, max_rows)
    shared, second = docs.sparkSession.sparkContext.broadcast(model), _second_person()
    empty = (np.zeros(0, np.uint64), np.zeros(0))

    def emit(batch):
        m = shared.value
        for first, n, x in _feature_chunks(batch.column(1), m.lexicon or empty, second):
            s = m.score(x)
            yield {"doc_id": batch.column(0).slice(first, n), "score": pa.array(s),
                   "predicted": pa.array((s >= 0.5).astype(np.int32))}

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_arrow(docs.select("doc_id", "text"), emit, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", (crc_fold("doc_id") == 0).alias("held_out"), "score", "predicted")
