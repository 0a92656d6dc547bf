"""Token counts: greedy longest-match word pieces by a linear automaton.

A word (run without ASCII white space) is cut into pieces from its beginning,
each the longest one in the vocabulary; pieces that begin a word and pieces
that continue one are different sets.  A word with no such cut is one unknown
token.

Instead of trying every length at every place, one automaton reads each byte
once: a trie of the pieces whose nodes have failure links.  Following a link
from a node closes as many pieces as the node has stored, so that only counts
are kept and no piece is ever built.  All distinct words of a chunk step
through the automaton together, in numpy.

The vocabulary comes from a file of a public tokenizer (byte pieces by rank);
pieces that begin with a space begin words.  The automaton is built on the
driver and broadcast: its size depends on the vocabulary alone, which may have
``MAX_PIECES`` pieces.

Once only ``FEW`` words of a chunk go on, each is finished by itself, byte by
byte over a dictionary, which is faster then: words of any length (base64,
unspaced text) take about a microsecond a byte.

Defined cases: null and empty texts have no words and no tokens; words of any
length are counted whole; every row is counted on its own; other columns are
not read.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .tables import map_arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_PIECES = 1_000_000
FEW = 32


@dataclass
class Automaton:
    """Trie of both sets; node 0 begins words, node 1 continues them.  Edges are sorted keys node * 256 + byte."""

    keys: np.ndarray
    to: np.ndarray
    fail: np.ndarray     # node after closing pieces, -1 without one
    popped: np.ndarray   # pieces closed on the way there
    _lists: tuple | None = field(default=None, repr=False)  # the same as a dictionary and lists, when first needed

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of pieces of each word; 1 for words that have no cut."""
        n = len(starts)
        total, node, dead = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")
        active = np.searchsorted(-sizes[order], -np.arange(1, (sizes.max() if n else 0) + 1), side="right")
        for i, m in enumerate(active):  # the m words that have a byte at place i
            rows = order[:m]
            if m <= FEW:
                for r in rows[~dead[rows]].tolist():
                    word = data[starts[r] + i:ends[r]].tobytes()
                    node[r], total[r], dead[r] = self._go_on(int(node[r]), int(total[r]), word)
                break
            byte = data[starts[rows] + i].astype(np.int64)
            todo = np.flatnonzero(~dead[rows])
            while len(todo):
                r = rows[todo]
                nxt = self.step(node[r], byte[todo])
                ok = nxt >= 0
                node[r[ok]] = nxt[ok]
                todo, r = todo[~ok], r[~ok]
                back = self.fail[node[r]]
                total[r] += self.popped[node[r]]
                dead[r[back < 0]] = True
                node[r] = np.maximum(back, 0)
                todo = todo[back >= 0]
        # the end of the word closes pieces until nothing is open
        todo = np.flatnonzero(~dead & (node != 1) & (sizes > 0))
        while len(todo):
            back = self.fail[node[todo]]
            total[todo] += self.popped[node[todo]]
            dead[todo[back < 0]] = True
            node[todo] = np.maximum(back, 0)
            todo = todo[back > 1]
        total[dead] = 1
        return total


    def _go_on(self, node: int, total: int, rest: bytes) -> tuple[int, int, bool]:
        """A word's node, closed pieces and whether it has no cut, after some more bytes."""
        if self._lists is None:
            self._lists = dict(zip(self.keys.tolist(), self.to.tolist())), self.fail.tolist(), self.popped.tolist()
        edges, fail, popped = self._lists
        for byte in rest:
            while (nxt := edges.get(node * 256 + byte)) is None:
                total += popped[node]
                back = fail[node]
                if back < 0:
                    return 0, total, True
                node = back
            node = nxt
        return node, total, False


def build(initial: Iterable[bytes], continuing: Iterable[bytes]) -> Automaton:
    """The automaton of two piece sets; raises if they are empty or beyond ``MAX_PIECES``."""
    child: list[dict[int, int]] = [{}, {}]
    whole = [False, False]
    sets = [set(initial) - {b""}, set(continuing) - {b""}]
    if not 0 < sum(map(len, sets)) <= MAX_PIECES:
        raise ValueError(f"a vocabulary must have 1 to {MAX_PIECES} pieces")
    for root, pieces in enumerate(sets):
        for piece in pieces:
            at = root
            for b in piece:
                if b not in child[at]:
                    child[at][b] = len(child)
                    child.append({})
                    whole.append(False)
                at = child[at][b]
            whole[at] = True
    fail, popped = [-1] * len(child), [0] * len(child)
    queue = deque([0, 1])
    while queue:  # parents before children
        u = queue.popleft()
        for b, v in child[u].items():
            if whole[v]:
                fail[v], popped[v] = 1, 1
            else:
                z, closed = fail[u], popped[u]
                while z >= 0 and b not in child[z]:
                    closed += popped[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], popped[v] = child[z][b], closed
            queue.append(v)
    edges = sorted((u * 256 + b, v) for u, c in enumerate(child) for b, v in c.items())
    keys, to = np.array(edges, np.int64).T
    return Automaton(np.ascontiguousarray(keys), np.ascontiguousarray(to), np.array(fail), np.array(popped))


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], list[bytes]]:
    """(pieces that begin words, pieces that continue them) of a file of base64 pieces and ranks.

    The space before a word is part of its first piece there, and is left out.
    Single bytes may begin words too, so that no word is unknown.
    """
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return ([p[1:] for p in pieces if p[:1] == b" "] + [p for p in pieces if len(p) == 1],
            [p for p in pieces if p[:1] != b" "])


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per document row (doc_id, n_words, n_tokens)."""
    shared = docs.sparkSession.sparkContext.broadcast(build(*read_vocabulary(vocabulary)))

    def emit(batch):
        for w in W.word_chunks(batch.column(1)):
            _, first, place = np.unique(w.hashes(), return_index=True, return_inverse=True)
            n = shared.value.count(w.data, w.starts[first], w.ends[first])[place]
            sums = np.concatenate([[0], np.cumsum(n)])
            yield {"doc_id": batch.column(0).slice(w.first, w.n_docs), "n_words": pa.array(w.counts.astype(np.int64)),
                   "n_tokens": pa.array(sums[w.ptr[1:]] - sums[w.ptr[:-1]])}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), emit, f"doc_id {kind}, n_words long, n_tokens long")
