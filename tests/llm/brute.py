"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def lower(text):
    return (text or "").translate(LOWER)


def words(text, pattern=PLAIN):
    return pattern.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold(doc_id, n=5):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def groups(nodes, links):
    """{node: smallest node reachable}."""
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def substring_dedup(rows, k=13):
    """[(doc_id, n_words, n_removed, sha)] of (doc_id, text)."""
    last = 1 << 70
    first, out = {}, []
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1):
            key, d2 = tuple(w[i:i + k]), last if d is None else d
            first[key] = min(first.get(key, d2), d2)
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] < (last if d is None else d):
                gone[i:i + k] = [True] * k
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def shingles(text, k):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def near_duplicates(rows, k=2, percent=80):
    """{doc_id: (n_shingles, component)} of (doc_id, text) with distinct ids."""
    sets = {d: shingles(t, k) for d, t in rows if d is not None}
    ids = [d for d in sets if sets[d]]
    links = []
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            n = len(x & y)
            if 100 * n >= percent * (len(x) + len(y) - n):
                links.append((a, b))
    comp = groups(sets, links)
    return {d: (len(s), comp[d]) for d, s in sets.items()}


def contamination(rows, bench, k=10):
    """[(doc_id, n_words, n_hit, n_items, sha)]."""
    wins = {}
    for item, t in bench:
        w = words(lower(t), ALNUM)
        n = min(k, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i:i + n]), set()).add("" if item is None else str(item))
    sizes = {len(x) for x in wins}
    out = []
    for d, t in rows:
        w = words(lower(t), ALNUM)
        hit, items = [False] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = wins.get(tuple(w[i:i + n]))
                if found:
                    items |= found
                    hit[i:i + n] = [True] * n
        out.append((d, len(w), sum(hit), len(items), sha(",".join(sorted(items)))))
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if PLAIN.search(x)]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    rep = [False] * len(w)
    for i in range(len(w) - 2):
        if windows[tuple(w[i:i + 3])] > 1:
            rep[i:i + 3] = [True] * 3
    failed = len(w) < 50 or 100 * sum(rep) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), sum(rep), failed)


def pieces(word, initial, continuing):
    """Greedy longest match, piece by piece."""
    at, n = 0, 0
    while at < len(word):
        known = continuing if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def targets(size_of, weights=(3, 1, 2), budget=1.5, most=2):
    """{source: target} by sharing the excess until none is above."""
    order = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = budget * sum(size_of.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > most * size_of[s]}
        if not above:
            return out | {s: left * weight[s] / total for s in free}
        for s in above:
            out[s] = most * size_of[s]
        left -= sum(out[s] for s in above)
        free -= above
    return out


def line_dedup(rows, percent=80):
    """[(doc_id, n_lines, n_removed, kept text)] of (doc_id, text), in doc_id order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] or ""))
    earlier, out = [], {}
    for i in order:
        d, t = rows[i]
        kept, gone, n = [], 0, 0
        for line in ("" if t is None else t).split("\n"):
            s = set(words(lower(line)))
            n += bool(s)
            same = s and any(
                100 * len(s & e) >= percent * len(s | e) for e in earlier
                if 100 * min(len(s), len(e)) >= percent * max(len(s), len(e)))
            if s:
                earlier.append(s)
            if same:
                gone += 1
            else:
                kept.append(line)
        out[i] = (d, n, gone, None if t is None else "\n".join(kept))
    return [out[i] for i in range(len(rows))]


def runs(x):
    """[(start, length, period)] of a word list: every period tried at every place."""
    out = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(x, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(x) if i not in gone)


def planted(doc_id, x):
    """The words after the change that op13's contract makes."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(x)
    if h % 10 or not n:
        return x
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x[a + (i - a) % p] if i >= a else x[i] for i in range(n)]


def strongest(found):
    """The run of greatest length / period; ties by start, then period."""
    from fractions import Fraction
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def rankings(rows, items, top=50):
    """[[(doc_id, score), ...]] of each item."""
    import math
    docs = [(d, Counter(words(lower(t), ALNUM))) for d, t in rows]
    docs = [(d, c) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for _, text in items:
        terms, scored = set(words(lower(text), ALNUM)), []
        for d, c in docs:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out.append([(None if gone else d, -s) for s, gone, d in sorted(scored)[:top]])
    return out


def base_secrets(text):
    """[(start, kind, end)] by the patterns as the contract states them."""
    patterns = (("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
                 r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
                ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
    return sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(patterns)
                  for m in re.finditer(p, text or "") if len(m.group(g)) >= least)
