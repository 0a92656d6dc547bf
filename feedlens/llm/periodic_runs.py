"""Periodic runs of words, found on a grammar of the text.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), at least ``MIN_WORDS`` long and ``MIN_EXPONENT`` periods long,
that no neighbouring word extends.

Documents are dealt to tasks by Spark and no row leaves its task.  Inside a
task, the documents of a chunk (about 2 MB, or one longer document) share one
grammar:

1. Re-Pair over the word ids (:func:`grammar`): repeated pairs of neighbouring
   symbols become nonterminals, the most frequent ones first, in rounds; a round
   replaces every pair that is more frequent than the pairs it overlaps.  A
   boundary between two words thus lies in the middle of exactly one occurrence
   of one nonterminal, or stays between two symbols of the final sequence.
2. A run that lies inside occurrences of nonterminals crosses the middle of the
   innermost one, wholly inside it.  So each nonterminal is examined once, in one
   occurrence, for stretches of period q across its middle (:func:`crossing`);
   boundaries of the final sequence are examined in their whole document.
3. What a nonterminal holds is moved to every place it is derived at, and
   stretches inside a longer one of the same period go (:func:`maximal`).

Candidate periods of a boundary come from recurring windows of 1, 2, 4, ...
words (:func:`recurrences`): a run of period q and four periods or more has,
directly before or behind each boundary in it, a window of L words, q <= L < 2q,
whose nearest recurrence is exactly q words away; nearer ones would make q no
smallest period.  Only windows whose halves recur are looked at, so prose drops
out after a few lengths.  Names of windows are exact; 64-bit hashes stand for
the words.

Cost: about O(n log n) a chunk.  Memory: some arrays of the chunk's words.

Defined cases: null, empty and white-space texts have no words, no runs and an
empty collapsed text; texts of any length are taken whole; every row is judged
by itself, so repeated rows and equal ids give a row each; null ids stay null;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .tables import map_arrow

MIN_WORDS = 6
MIN_EXPONENT = 4
# Words compared at once when stretches are extended, over all stretches of a chunk
_STRIDE = 1 << 16


def grammar(symbols: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (nonterminal, start, middle, end) of every occurrence, in word positions.

    ``symbols`` are the word ids of the documents one after another and ``docs``
    the document of each; pairs never join two documents.  Boundaries that no
    occurrence has as its middle belong to the final sequence.
    """
    sym, start = symbols.astype(np.int64), np.arange(len(symbols))
    end, made, top = start + 1, [], int(symbols.max()) + 1 if len(symbols) else 1
    live = np.append(docs[1:] == docs[:-1], False)[:len(sym)]  # the pair of a symbol and the next one may be repeated
    while live.any():
        at = np.flatnonzero(live)
        keys, pair, count = np.unique(sym[at] * top + sym[at + 1], return_inverse=True, return_counts=True)
        # a pair found once stays so: what its symbols become later occurs no more often
        repeated = count[pair] > 1
        live[at[~repeated]] = False
        if not repeated.any():
            break
        weight = np.empty(len(count), np.int64)
        # equally frequent pairs in a scattered order: in order of ids, a round might replace one pair only
        weight[np.lexsort((W.mix(keys.astype(np.uint64)), count))] = np.arange(1, len(count) + 1)
        w = np.zeros(len(sym) + 2, np.int64)
        w[at[repeated] + 1] = weight[pair[repeated]]
        here, left, right = w[1:-1], w[:-2], w[2:]
        # the heaviest of overlapping pairs; of a row of one pair (a a a a), every second
        first = here != left
        place = np.arange(len(sym))
        odd = (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 1
        chosen = np.flatnonzero((here > 0) & ~odd & (~first | (here > left)) & (here >= right))
        _, kind = np.unique(here[chosen], return_inverse=True)
        made.append((top + kind, start[chosen], start[chosen + 1], end[chosen + 1]))
        sym[chosen], end[chosen], live[chosen] = top + kind, end[chosen + 1], live[chosen + 1]
        top += int(kind.max()) + 1
        stays = np.ones(len(sym), bool)
        stays[chosen + 1] = False
        sym, start, end, live = sym[stays], start[stays], end[stays], live[stays]
        open_ = live.copy()  # symbols without a repeated pair are settled
        open_[1:] |= live[:-1]
        sym, start, end, live = sym[open_], start[open_], end[open_], live[open_]
    if not made:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*made))


def recurrences(ids: np.ndarray, docs: np.ndarray, ends: np.ndarray,
                most: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For windows of L = 1, 2, 4, ... words: (L, words to the next equal window, words to the previous one).

    Distances beyond ``most`` words, and none at all, are 0.  Windows end
    where their document ends (``ends``).
    """
    n, length = len(ids), 1
    at, key = np.arange(n), docs * (int(ids.max()) + 1 if n else 1) + ids
    while len(at) and length < 2 * most.max():
        order = np.argsort(key, kind="stable")
        k, p = key[order], at[order]
        same, gap = k[1:] == k[:-1], p[1:] - p[:-1]
        near = same & (gap <= most[p[1:]])
        ahead, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
        ahead[p[:-1][near]] = back[p[1:][near]] = gap[near]
        yield length, ahead, back
        name = np.zeros(n, np.int64)
        name[p[1:]] = np.cumsum(~same)
        recurs = (ahead > 0) | (back > 0)
        at = at[recurs[at]]
        at = at[at + 2 * length <= ends[at]]
        at = at[recurs[at + length]]
        key = name[at] * (len(p) + 1) + name[at + length]
        length *= 2


def _extended(ids: np.ndarray, at: np.ndarray, shift: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on, in direction ``step``, equal those ``shift`` further; at most ``room``."""
    out, active = np.zeros(len(at), np.int64), np.flatnonzero(room > 0)
    while len(active):
        wide = max(16, _STRIDE // len(active))
        left = np.minimum(room[active] - out[active], wide)
        wide = int(left.max())
        k = np.arange(wide)
        here = (at[active] + step * out[active])[:, None] + step * k
        here = np.where(k < left[:, None], here, at[active][:, None])
        equal = (ids[here] == ids[here + shift[active][:, None]]) & (k < left[:, None])
        got = np.where(equal.all(axis=1), wide, np.argmin(equal, axis=1))
        out[active] += got
        active = active[(got == wide) & (out[active] < room[active])]
    return out


def crossing(ids: np.ndarray, docs: np.ndarray, ends: np.ndarray, most: np.ndarray, middle: np.ndarray,
             lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(boundary, start, end, period) of the stretches across boundaries that are long enough for a run.

    Boundary i lies before word ``middle[i]`` and is examined in words
    ``lo[i]:hi[i]``; start and end are the longest possible there.
    """
    found = []
    for length, ahead, back in recurrences(ids, docs, ends, most):
        tries = []  # boundary, period, start of a stretch of that period and of length + period words beside it
        for p in (middle, middle - length):
            inside = np.flatnonzero((p >= lo) & (p + length <= hi))
            for gap, sign in ((ahead, 0), (back, 1)):
                d = gap[p[inside]]
                i = np.flatnonzero((2 * d > length) & (d <= length))
                tries.append((inside[i], d[i], p[inside[i]] - sign * d[i]))
        b, d, s = (np.concatenate(x) for x in zip(*tries))
        ok = (s >= lo[b]) & (s + d + length <= hi[b]) & (hi[b] - lo[b] >= MIN_EXPONENT * d)
        b, d, s = b[ok], d[ok], s[ok]
        if not len(b):
            continue
        # neighbouring windows that recur at the same distance belong to the stretch; what is left goes word by word
        # (stretches of one period may meet at a boundary, so each try counts for itself)
        new = np.append(True, ahead[1:] != ahead[:-1])
        group = np.cumsum(new) - 1
        bounds = np.append(np.flatnonzero(new), len(ahead))
        at = group[s]
        s, e = np.maximum(bounds[at], lo[b]), np.minimum(bounds[at + 1] - 1 + d + length, hi[b])
        e = e + _extended(ids, e, -d, hi[b] - e, 1)
        s = s - _extended(ids, s - 1, d, s - lo[b], -1)
        ok = (e - s >= np.maximum(MIN_WORDS, MIN_EXPONENT * d)) & (s < middle[b]) & (middle[b] < e)
        found.append((b[ok], s[ok], e[ok], d[ok]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches that lie in no other one of the same period, by start and period."""
    order = np.lexsort((-end, start, period))
    s, e, q = start[order], end[order], period[order]
    if len(s):
        reach = e + q * (int(e.max()) + 1)  # periods apart, so that one running maximum serves all
        seen = np.maximum.accumulate(reach)
        keep = np.append(True, reach[1:] > seen[:-1])
        s, e, q = s[keep], e[keep], q[keep]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def find_runs(ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period; document i has words ``ptr[i]:ptr[i + 1]``."""
    sizes = np.diff(ptr)
    docs = np.repeat(np.arange(len(sizes)), sizes)
    ends, begins, most = ptr[1:][docs], ptr[:-1][docs], (sizes // MIN_EXPONENT)[docs]
    if not len(ids) or most.max() < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    kind, start, middle, end = grammar(ids, docs)
    order = np.argsort(kind, kind="stable")
    kind, start, middle, end = kind[order], start[order], middle[order], end[order]
    head = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])) if len(kind) else np.zeros(0, np.int64)
    times = np.diff(np.append(head, len(kind)))
    free = np.append(False, docs[1:] == docs[:-1])  # boundaries of the final sequence
    free[middle] = False
    free = np.flatnonzero(free)
    b, s, e, q = crossing(ids, docs, ends, most, np.concatenate([middle[head], free]),
                          np.concatenate([start[head], begins[free]]), np.concatenate([end[head], ends[free]]))
    inner = b < len(head)
    g = b[inner]
    # to all places where the nonterminal is derived
    total = int(times[g].sum())
    which = np.repeat(np.arange(len(g)), times[g])
    nth = np.arange(total) - np.repeat(np.cumsum(times[g]) - times[g], times[g])
    move = start[head[g][which] + nth] - start[head[g]][which]
    return maximal(np.concatenate([s[inner][which] + move, s[~inner]]), np.concatenate([e[inner][which] + move, e[~inner]]),
                   np.concatenate([q[inner][which], q[~inner]]))


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, runs (array of start, length, period, by start and period) and the collapsed text.

    The collapsed text joins by one space the words that no run contains after its first period.
    """
    def emit(batch):
        for w in W.word_chunks(batch.column(1)):
            _, ids = np.unique(w.hashes(), return_inverse=True)
            s, e, q = find_runs(ids, w.ptr)
            cover = np.zeros(len(ids) + 1, np.int64)
            np.add.at(cover, s + q, 1)
            np.add.at(cover, e, -1)
            gone = np.cumsum(cover[:-1]) > 0
            ptr = np.searchsorted(s, w.ptr)
            base = w.ptr[np.searchsorted(w.ptr, s, side="right") - 1]
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (s - base, e - s, q)], ["start", "length", "period"])
            texts, some = [], np.add.reduceat(np.append(gone, False), w.ptr[:-1]) * (w.counts > 0) if w.n_docs else []
            for i in range(w.n_docs):
                own = w.data[w.offsets[i]:w.offsets[i + 1]].tobytes().split()
                if some[i]:
                    own = [x for x, g in zip(own, gone[w.ptr[i]:w.ptr[i + 1]].tolist()) if not g]
                texts.append(b" ".join(own))
            yield {"doc_id": batch.column(0).slice(w.first, w.n_docs),
                   "runs": pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), runs),
                   "collapsed": pa.array(texts, pa.binary()).cast(pa.string())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), emit, f"doc_id {kind}, runs array<{RUN}>, collapsed string")
