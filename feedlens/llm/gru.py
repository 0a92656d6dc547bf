"""A gated recurrent language model in numpy with a class-factored softmax output.

Token ids below ``n_head`` are words of the head vocabulary, the most frequent
first, cut into classes of consecutive ids with equal sums of the roots of their
counts: frequent words sit in small classes, so that few words are weighed for
most tokens.  Ids from ``n_head`` on are classes of rarer words, which have no
members here.  The model gives log P(class | state), and for head words
log P(word | class, state) on top.

Texts run in lanes, many at once, each from its beginning with an empty state;
the state is carried from window to window to the text's end.  Training
back-propagates within a window only.  A window has about the same number of
tokens whatever the number of lanes that reach it: where few long texts are
left, it has more steps.  Windows are cut from the tokens as they come, so what
is held goes by the tokens in hand and not by the longest text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

HIDDEN = 16
CLASSES = 64     # of head words
STEPS = 32       # steps of a window that all lanes reach
MAX_STEPS = 512  # steps of a window that few lanes reach
LANES = 256      # of scoring
TRAIN_LANES = 256
RATE = 0.15
CLIP = 5.0
_F = np.float32


def class_starts(head_counts: np.ndarray, n_classes: int = CLASSES) -> np.ndarray:
    """The first id of each class of head words, and the number of head words as the last bound."""
    roots = np.sqrt(head_counts + 0.5)
    share = (np.cumsum(roots) - roots) / roots.sum()
    kind = np.minimum((share * n_classes).astype(np.int64), n_classes - 1)
    return np.append(np.unique(kind, return_index=True)[1], len(head_counts))


def initial(head_counts: np.ndarray, rest_counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters that reproduce the unigram frequencies whatever the state."""
    rng = np.random.default_rng(seed)
    n, starts = len(head_counts), class_starts(head_counts)
    mass = np.concatenate([np.add.reduceat(head_counts + 0.5, starts[:-1]), rest_counts + 0.5])
    of_class = np.repeat(mass[:len(starts) - 1], np.diff(starts))
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(_F)
    # output tables: a row of weights for each class or word, its bias at the end
    biased = lambda bias: np.column_stack([small(len(bias), HIDDEN) * _F(0.1), bias]).astype(_F)
    return {"inputs": small(n + len(rest_counts), 3 * HIDDEN), "state": small(HIDDEN, 3 * HIDDEN),
            "classes": biased(np.log(mass / mass.sum())), "words": biased(np.log((head_counts + 0.5) / of_class))}


class Lanes:
    """Texts, end to end, in lanes of about equal length, the longest lane first."""

    def __init__(self, ids: np.ndarray, ptr: np.ndarray, n_lanes: int):
        sizes = np.diff(ptr)
        n_lanes = max(1, min(n_lanes, len(sizes)))
        heap, texts = [(0, b) for b in range(n_lanes)], [[] for _ in range(n_lanes)]
        for d in np.argsort(-sizes, kind="stable"):
            used, b = heap[0]
            texts[b].append(d)
            heapq.heapreplace(heap, (used + int(sizes[d]), b))
        order = [b for _, b in sorted(heap, reverse=True)]
        self.text = np.concatenate([np.array(texts[b], np.int64) for b in order])  # by place in the stream
        self.size = np.array([sizes[texts[b]].sum() for b in order], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bounds = np.concatenate([[0], np.cumsum(sizes[self.text])])
        self.stream = ids[np.repeat(ptr[:-1][self.text] - self.bounds[:-1], sizes[self.text]) + np.arange(len(ids))]

    def windows(self, n_tokens: int, end: int = 0) -> Iterator[tuple]:
        """(inputs, targets, keep, texts) of each window and the lanes that reach it.

        A step's input is the token before it; where a text begins, it is the end token and keep is 0.
        Targets are -1 where a lane has ended.
        """
        t = 0
        while (n := int((self.size > t).sum())):
            steps = min(max(STEPS, n_tokens // n), MAX_STEPS, int(self.size[0]) - t)
            at = self.start[:n] + np.arange(t, t + steps)[:, None]
            real = np.arange(t, t + steps)[:, None] < self.size[:n]
            at = np.where(real, at, self.start[:n])
            place = np.searchsorted(self.bounds, at, side="right") - 1
            first = self.bounds[place] == at
            given = np.where(first, end, self.stream[np.maximum(at - 1, 0)])
            yield given, np.where(real, self.stream[at], -1), (~first).astype(_F)[:, :, None], self.text[place]
            t += steps


def _sigmoid(x):
    return _F(0.5) * np.tanh(_F(0.5) * x) + _F(0.5)


def _softmax(h: np.ndarray, weights: np.ndarray, wanted: np.ndarray, rows: np.ndarray):
    """Log probability of the wanted outcome of each row, and the probabilities times their sums, and these sums."""
    e = h @ weights.T
    own = e[rows, wanted]
    np.exp(e, out=e)
    total = e @ np.ones(e.shape[1], _F)
    if not (total.min() > 1e-30 and total.max() < 1e30):  # biases are logs of shares: only far from them
        e = h @ weights.T
        top = e.max(axis=1)
        own = own - top
        np.exp(e - top[:, None], out=e)
        total = e.sum(axis=1)
    return own - np.log(total), e, total


class Model:
    def __init__(self, params: dict[str, np.ndarray], starts: np.ndarray):
        self.p, self.starts = params, starts
        self.n_head = len(params["words"])
        rest = len(params["inputs"]) - self.n_head
        self.kind = np.repeat(np.arange(len(starts) - 1 + rest), np.append(np.diff(starts), np.ones(rest, np.int64)))

    def run(self, given: np.ndarray, keep: np.ndarray, h: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """States (steps x lanes x HIDDEN) after each step's input; ``trace`` gets what going back needs."""
        p, k = self.p, HIDDEN
        shape = (*given.shape, k)
        out = np.empty(shape, _F)
        if trace is not None:
            trace.update({c: np.empty(shape, _F) for c in ("before", "z", "r", "n", "g")})
        x = p["inputs"][given]
        for t in range(len(given)):
            h = h * keep[t]
            g = h @ p["state"]
            zr = _sigmoid(x[t, :, :2 * k] + g[:, :2 * k])
            z, r, g = zr[:, :k], zr[:, k:], g[:, 2 * k:]
            n = np.tanh(x[t, :, 2 * k:] + r * g)
            if trace is not None:
                for c, value in zip(("before", "z", "r", "n", "g"), (h, z, r, n, g)):
                    trace[c][t] = value
            h = n + z * (h - n)
            out[t] = h
        return out

    def log_probs(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None):
        """Natural log probability of each target given its state, and the gradient by the state.

        ``grads`` gets the gradients; of words, by the class, for the classes that occur.
        """
        p = self.p
        order = np.argsort(self.kind[targets], kind="stable")
        h, targets = np.ones((len(order), HIDDEN + 1), _F), targets[order]
        h[:, :-1] = states[order]
        rows, kind = np.arange(len(targets)), self.kind[targets]
        got, e, total = _softmax(h, p["classes"], kind, rows)
        if grads is not None:
            # gradients by logits are e / total less 1 at the target; the small factors are divided, not e
            e[rows, kind] -= total
            total = total[:, None]
            grads["classes"], grads["words"] = e.T @ (h / total), {}
            dh = e @ p["classes"][:, :-1] / total
        cuts = np.searchsorted(kind, np.arange(len(self.starts)))
        for c in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(self.starts) > 1)):
            at, block = slice(cuts[c], cuts[c + 1]), slice(self.starts[c], self.starts[c + 1])
            own, w = h[at], p["words"][block]
            some, place = rows[:len(own)], targets[at] - self.starts[c]
            logp, e, total = _softmax(own, w, place, some)
            got[at] += logp
            if grads is not None:
                e[some, place] -= total
                total = total[:, None]
                grads["words"][block.start, block.stop] = e.T @ (own / total)
                dh[at] += e @ w[:, :-1] / total
        out = np.empty_like(got)
        out[order] = got
        if grads is None:
            return out, None
        back = np.empty_like(dh)
        back[order] = dh
        return out, back

    def score(self, ids: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Natural log probability of each whole text (rarer words: of their class)."""
        out = np.zeros(len(ptr) - 1)
        if not len(ids):
            return out
        lanes = Lanes(ids, ptr, LANES)
        h = np.zeros((len(lanes.size), HIDDEN), _F)
        for given, targets, keep, texts in lanes.windows(STEPS * LANES):
            states = self.run(given, keep, h[:given.shape[1]])
            h = states[-1]
            real = targets >= 0
            logp, _ = self.log_probs(states[real], targets[real])
            out += np.bincount(texts[real], weights=logp, minlength=len(out))
        return out

    def train(self, ids: np.ndarray, ptr: np.ndarray, squares: dict[str, np.ndarray]) -> None:
        """One pass of truncated back-propagation with adaptive steps (sums of squares per parameter)."""
        if not len(ids):
            return
        lanes = Lanes(ids, ptr, TRAIN_LANES)
        h = np.zeros((len(lanes.size), HIDDEN), _F)
        for given, targets, keep, _ in lanes.windows(STEPS * TRAIN_LANES):
            trace: dict = {}
            states = self.run(given, keep, h[:given.shape[1]], trace)
            h = states[-1]
            real = targets >= 0
            grads: dict = {}
            _, dh = self.log_probs(states[real], targets[real], grads)
            dstates = np.zeros_like(states)
            dstates[real] = dh
            used, rows = self._backward(given, keep, trace, dstates, grads)
            # steps touch the classes and the input rows of tokens that occurred
            parts = [(k, slice(None), grads[k]) for k in ("state", "classes")] + [("inputs", used, rows)]
            parts += [("words", slice(*block), g) for block, g in grads["words"].items()]
            scale = _F(1.0 / (STEPS * TRAIN_LANES))  # windows of fewer tokens weigh less
            size = float(scale) * np.sqrt(sum(float(np.vdot(g, g)) for _, _, g in parts))
            scale *= _F(min(1.0, CLIP / max(size, 1e-9)))
            for k, at, g in parts:
                g *= scale
                sums = squares[k][at] + g * g
                squares[k][at] = sums
                np.sqrt(sums, out=sums)
                sums += _F(1e-6)
                g *= _F(RATE)
                g /= sums
                self.p[k][at] -= g

    def _backward(self, given, keep, trace, dstates, grads) -> tuple[np.ndarray, np.ndarray]:
        """Adds the gradient of the state weights; returns that of the input table by token id."""
        back, k = np.ascontiguousarray(self.p["state"].T), HIDDEN
        z, r, n = trace["z"], trace["r"], trace["n"]
        by_n, by_z, by_r = (1 - z) * (1 - n * n), (trace["before"] - n) * z * (1 - z), trace["g"] * r * (1 - r)
        dg = np.empty((*given.shape, 3 * k), _F)
        carry = np.zeros_like(dstates[0])
        for t in range(len(given) - 1, -1, -1):
            d = carry
            d += dstates[t]
            dn, here = d * by_n[t], dg[t]
            here[:, :k] = d * by_z[t]
            here[:, k:2 * k] = dn * by_r[t]
            here[:, 2 * k:] = dn * r[t]
            dstates[t] = dn
            carry = d * z[t]
            carry += here @ back
            carry *= keep[t]
        flat = dg.reshape(-1, 3 * k)
        grads["state"] = trace["before"].reshape(-1, k).T @ flat
        dg[:, :, 2 * k:] = dstates  # the input stands beside the reset state, not under it
        order = np.argsort(given, axis=None, kind="stable")
        ids, first = np.unique(given.reshape(-1)[order], return_index=True)
        return ids, np.add.reduceat(flat[order], first, axis=0)


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].reshape(-1) for k in sorted(params)])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = values[at:at + n].reshape(like[k].shape).astype(_F)
        at += n
    return out
