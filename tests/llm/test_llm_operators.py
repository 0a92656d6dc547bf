"""Every operator against plain Python, on given documents and on awkward ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from feedlens.llm import catalog
from feedlens.llm.compression import compression_quality, in_bands, ratios
from feedlens.llm.decontamination import decontaminate
from feedlens.llm.line_dedup import dedup_lines
from feedlens.llm.lm_scoring import score_documents
from feedlens.llm.minhash_dedup import near_duplicates
from feedlens.llm.mixing import MOST, assign, mix
from feedlens.llm.substring_dedup import COVERS, dedup_substrings
from feedlens.llm.token_counts import build, count_tokens, read_vocabulary
from feedlens.llm.toxicity import toxicity
from feedlens.llm.url_filter import filter_urls
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"

_RNG = random.Random(5)
_VOCAB = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(400)]


def prose(n, rng=_RNG):
    return " ".join(rng.choice(_VOCAB) + ("\n" if rng.random() < 0.06 else "") for _ in range(n))


def awkward_rows():
    """Nulls, empty and white-space texts, copies, near copies, shared passages, repeated rows, one long text."""
    rng = random.Random(11)
    base, passage = prose(120, rng), prose(40, rng).replace("\n", "")
    near = base.split(" ")
    near[60] = "Changed"
    long = prose(9000, rng)
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n\x0b\r "), (7, "one"), (8, "ONE"),
            (9, prose(80, rng) + " " + passage), (10, passage + " " + prose(90, rng)), (11, long), (12, long + " End"),
            (13, "a b c d\na b c d e\nA B C D\nx"), (14, "a b c d e\n\nz z z z z z"), (15, "spam " * 300),
            (16, prose(30, rng) + "\r\n" + passage), (17, "\u00a0nbsp\u2003wide \u00c9T\u00c9"), (18, base.upper()),
            (20, "tie " * 12 + "x"), (19, "tie " * 12 + "x")]
    return rows


@pytest.fixture(scope="module")
def awkward(spark):
    """The awkward rows with columns whose names operators use inside."""
    rows = [(d, t, "en", None if d % 3 == 0 else f"s{d % 4}", 1, "x", "y", 2.5, 7) for d, t in awkward_rows()]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, h string, row string, "
              "n_words double, node long")
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


# -- queries with SQL ---------------------------------------------------------

@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, name):
    result = compare(catalog.queries()[name](spark, SF), duck(SF), catalog.oracle_sql()[name])
    assert result["ok"], result


# -- 1 ------------------------------------------------------------------------

def test_token_counts(spark, awkward, empty, documents):
    initial, continuing = (set(x) for x in read_vocabulary())
    for df in (awkward, documents.limit(60)):
        rows = dict(pairs(df))
        for r in count_tokens(df).collect():
            ws = brute.words(rows[r.doc_id])
            assert r.n_words == len(ws)
            assert r.n_tokens == sum(brute.pieces(w.encode(), initial, continuing) for w in ws)
    assert count_tokens(empty).count() == 0


def test_automaton_matches_greedy_on_random_vocabularies():
    rng = random.Random(3)
    for _ in range(60):
        word = lambda n: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, n)))
        initial, continuing = {word(5) for _ in range(8)}, {word(5) for _ in range(8)}
        a = build(initial, continuing)
        texts = [word(14) for _ in range(40)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        got = a.count(data, ends - [len(t) for t in texts], ends)
        assert got.tolist() == [brute.pieces(t, initial, continuing) for t in texts]


def test_very_long_words(monkeypatch):
    """Their time goes by their bytes, and few long words among many short ones are counted right."""
    import time

    from feedlens.llm import token_counts

    initial, continuing = (set(x) for x in read_vocabulary())
    a, rng = build(initial, continuing), random.Random(9)
    texts = [bytes(rng.choice(b"abcdefghiABC0123+/") for _ in range(n)) for n in [3, 9, 40] * 50 + [900, 20_000, 1_000_000]]
    ends = np.cumsum([len(t) for t in texts])
    begun = time.process_time()
    got = a.count(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends)
    assert time.process_time() - begun < 20
    assert got[:-2].tolist() == [brute.pieces(t, initial, continuing) for t in texts[:-2]]
    # all words in step, as without the dictionary
    monkeypatch.setattr(token_counts, "FEW", 0)
    assert got[:-1].tolist() == a.count(np.frombuffer(b"".join(texts[:-1]), np.uint8),
                                        (ends - [len(t) for t in texts])[:-1], ends[:-1]).tolist()


def test_vocabulary_bounds():
    with pytest.raises(ValueError):
        build([], [])


# -- 2 ------------------------------------------------------------------------

def test_url_filter(spark):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme/porn": ("", "", None, "block"),
        "http://a.NET/x?y": ("a.net", "/x", "net/", "block"), "http://net/": ("net", "/", "net/", "block"),
        "http://planet/": ("planet", "/", None, "allow"), "http://a.net": ("a.net", "", None, "allow"),
        "https://www.example.net/en/1": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.net/english": ("example.net", "/english", "net/", "block"),
        "https://x.org/fr/viagra": ("x.org", "/fr/viagra", "org/fr/", "allow"),
        "https://x.org/viagra": ("x.org", "/viagra", None, "block"),
        "https://x.org/viagras": ("x.org", "/viagras", None, "allow"),
        "https://cheap.org/cheap": ("cheap.org", "/cheap", None, "allow"),
        "https://cheap-PILLS.org/": ("cheap-pills.org", "/", None, "block"),
        "x://h?q://z": ("h", "", None, "allow"), "http://a\nb.net/c#d": ("a\nb.net", "/c", "net/", "block"),
    }
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(cases)], "page_id long, url string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert filter_urls(df.limit(0)).count() == 0


# -- 3 ------------------------------------------------------------------------

def test_language_model(spark, awkward, empty, documents):
    import math
    from collections import Counter

    extra = awkward.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 100_000)
    df = documents.select("doc_id", "text").union(extra)
    rows = dict(pairs(df))
    tokens = {d: brute.words(brute.lower(t)) + ["\n"] for d, t in rows.items()}
    seen = Counter(w for d, ws in tokens.items() if brute.fold(d) != 1 for w in ws)
    n, v = sum(seen.values()), len(seen)
    held = []
    for r in score_documents(df).collect():
        ws = tokens[r.doc_id]
        base = sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            brute.fold(r.doc_id) == 1, len(ws), sum(w in seen for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        if r.held_out:
            held.append((r.base_score, r.score))
    assert sum(s for _, s in held) > sum(b for b, _ in held)
    assert score_documents(empty).count() == 0


def test_language_model_vocabulary_covers_the_text(spark):
    from feedlens.llm.lm_scoring import vocabulary, word_counts

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    v, head_counts = vocabulary(word_counts(docs).cache(), 1)
    assert head_counts[1:].sum() > 0.8 * (v.total - v.n_ends)
    rows = score_documents(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_language_model_probabilities_sum_to_one():
    from feedlens.llm import gru

    counts = np.arange(100, 0, -1).astype(float)
    model = gru.Model(gru.initial(counts, np.array([5.0, 3.0])), gru.class_starts(counts))
    h = np.random.default_rng(1).normal(size=(1, gru.HIDDEN)).astype(np.float32)
    targets = np.concatenate([np.arange(100), [model.n_head, model.n_head + 1]]).astype(np.int32)
    logp, _ = model.log_probs(np.repeat(h, len(targets), 0), targets)
    assert np.exp(logp).sum() == pytest.approx(1, abs=1e-4)


def test_language_model_gradient():
    from feedlens.llm import gru

    rng = np.random.default_rng(2)
    params = {k: v.astype(np.float64) for k, v in gru.initial(np.ones(70), np.ones(2)).items()}
    model = gru.Model(params, gru.class_starts(np.ones(70), 6))
    params["classes"] = rng.normal(0, 0.1, (8, gru.HIDDEN + 1))  # six classes of words and two of rarer ones
    given = rng.integers(0, 70, (4, 3)).astype(np.int32)
    targets = rng.integers(0, 70, (4, 3)).astype(np.int32)
    keep = np.ones((4, 3, 1))
    keep[2, 1] = 0

    def loss():
        s = model.run(given, keep, np.zeros((3, gru.HIDDEN)))
        return -model.log_probs(s.reshape(-1, gru.HIDDEN), targets.reshape(-1))[0].sum()

    trace = {}
    s = model.run(given, keep, np.zeros((3, gru.HIDDEN)), trace)
    grads = {}
    _, dh = model.log_probs(s.reshape(-1, gru.HIDDEN), targets.reshape(-1), grads)
    used, rows = model._backward(given, keep, trace, dh.reshape(s.shape), grads)
    grads["inputs"] = np.zeros_like(params["inputs"])
    grads["inputs"][used] = rows
    blocks, grads["words"] = grads["words"], np.zeros_like(params["words"])
    for (a, b), g in blocks.items():
        grads["words"][a:b] = g
    for name in ("state", "inputs", "classes", "words"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        params[name][at] += 1e-3
        up = loss()
        params[name][at] -= 2e-3
        down = loss()
        params[name][at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(grads[name][at], rel=2e-2)


def test_score_does_not_depend_on_lanes():
    from feedlens.llm import gru

    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 90, 40)
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    ids = rng.integers(0, 64, ptr[-1]).astype(np.int32)
    ids[ptr[1:] - 1] = 0
    model = gru.Model(gru.initial(np.ones(64), np.ones(2)), gru.class_starts(np.ones(64)))
    alone = [model.score(ids[a:b], np.array([0, b - a]))[0] for a, b in zip(ptr[:-1], ptr[1:])]
    assert model.score(ids, ptr) == pytest.approx(alone, rel=1e-4)


def test_score_equals_a_network_written_number_by_number():
    from feedlens.llm import gru

    counts = np.array([40.0, 30, 9, 8, 7, 3, 2, 2, 2, 1, 1])
    rest, starts = np.array([5.0, 3.0]), gru.class_starts(counts, 4)
    p = gru.initial(counts, rest)
    rng = np.random.default_rng(5)
    p["classes"] = rng.normal(0, 0.4, (len(starts) - 1 + len(rest), gru.HIDDEN + 1)).astype(np.float32)
    p["words"] = rng.normal(0, 0.4, p["words"].shape).astype(np.float32)
    p = {k: v * np.float32(4) if k in ("inputs", "state") else v for k, v in p.items()}
    texts = [[3, 12, 1, 5, 11, 4, 0], [0], [2, 2, 10, 9, 8, 7, 6] * 30 + [0]]
    k = gru.HIDDEN

    def sigmoid(x):
        return 1 / (1 + math.exp(-x))

    def log_share(rows, h, wanted):
        logits = {i: sum(float(w) * x for w, x in zip(rows[i], [*h, 1.0])) for i in range(len(rows))}
        return logits[wanted] - math.log(sum(math.exp(x) for x in logits.values()))

    def slow(text):
        h, before, total = [0.0] * k, 0, 0.0
        for token in text:
            x = [float(v) for v in p["inputs"][before]]
            g = [sum(h[i] * float(p["state"][i, j]) for i in range(k)) for j in range(3 * k)]
            z, r = ([sigmoid(x[a + i] + g[a + i]) for i in range(k)] for a in (0, k))
            n = [math.tanh(x[2 * k + i] + r[i] * g[2 * k + i]) for i in range(k)]
            h = [n[i] + z[i] * (h[i] - n[i]) for i in range(k)]
            if token >= len(counts):
                total += log_share(p["classes"], h, len(starts) - 1 + token - len(counts))
            else:
                kind = max(c for c in range(len(starts) - 1) if starts[c] <= token)
                total += log_share(p["classes"], h, kind)
                total += log_share(p["words"][starts[kind]:starts[kind + 1]], h, token - starts[kind])
            before = token
        return total

    ids, ptr = np.concatenate(texts).astype(np.int32), np.cumsum([0, *map(len, texts)])
    assert gru.Model(p, starts).score(ids, ptr) == pytest.approx([slow(t) for t in texts], rel=1e-4)


def test_language_model_memory_beside_a_long_text():
    import tracemalloc

    from feedlens.llm import gru

    sizes = np.array([300_000] + [40] * 255)
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.random.default_rng(6).integers(1, 64, ptr[-1]).astype(np.int32)
    ids[ptr[1:] - 1] = 0
    model = gru.Model(gru.initial(np.ones(64), np.ones(2)), gru.class_starts(np.ones(64)))
    tracemalloc.start()
    model.score(ids, ptr)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20


def test_language_model_classes_hold_equal_shares_of_roots():
    from feedlens.llm import gru

    counts = 1e6 / np.arange(1, 5001)
    starts = gru.class_starts(counts)
    roots = np.add.reduceat(np.sqrt(counts), starts[:-1])
    assert starts[0] == 0 and starts[-1] == 5000 and (np.diff(starts) > 0).all()
    assert roots.max() < 2.5 * roots.mean() and np.diff(starts)[0] < np.diff(starts)[-1]
    assert list(gru.class_starts(np.array([3.0]))) == [0, 1]


# -- 4 ------------------------------------------------------------------------

def contaminated(df, bench):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate(df, bench).collect()),
                  key=str)


def test_decontamination(spark, awkward, empty):
    rows = awkward_rows()
    ws = rows[0][1].split()
    items = [(1, " ".join(ws[10:24])), (2, " ".join(ws[10:24]).upper()), (3, "one"), (4, "tie, tie!"), (5, None), (6, "..."),
             (None, " ".join(ws[40:50])), (8, " ".join(ws[60:69])), (8, " ".join(ws[70:79])), (9, "never seen words")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    assert contaminated(awkward, bench) == sorted(brute.contamination(rows, items), key=str)
    assert contaminated(empty, bench) == []
    clean = contaminated(awkward, bench.limit(0))
    assert all(r[2:4] == (0, 0) for r in clean) and len(clean) == len(rows)


def test_decontamination_finds_every_window_at_any_offset(spark):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(25)]
    rows, items = [], [(1, " ".join(passage))]
    for i in range(300):
        a = rng.randint(0, 15)
        n = rng.randint(8, 12)
        rows.append((i, " ".join(prose(rng.randint(0, 30), rng).split() + passage[a:a + n] + prose(9, rng).split())))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert contaminated(docs, bench) == sorted(brute.contamination(rows, items), key=str)


# -- 5 ------------------------------------------------------------------------

def test_quality_rules(spark, awkward, empty, documents):
    import zstandard

    for df in (awkward, documents):
        rows = dict(pairs(df))
        for r in compression_quality(df).collect():
            want = brute.quality(rows[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
            raw = (rows[r.doc_id] or "").encode()
            whole, parts = ratios(raw, zstandard.ZstdCompressor(level=3))
            assert r.kept == (not want[-1] and in_bands(len(raw), whole, parts))
    assert compression_quality(empty).count() == 0


def test_quality_bands_reject_repetition_and_noise():
    import zstandard

    rng, packer = random.Random(1), zstandard.ZstdCompressor(level=3)
    ok = lambda t: in_bands(len(t.encode()), *ratios(t.encode(), packer))
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea"]
    text = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))) for _ in range(900))
    assert ok(text)
    assert not ok("the same few words again and " * 200)
    assert not ok("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(6000)))


def test_quality_verdict_does_not_depend_on_where_noise_stands(spark):
    import base64

    rng = random.Random(9)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea"]
    plain = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))) for _ in range(2000))[:8192]
    noise = base64.encodebytes(rng.randbytes(4000)).decode()[:4095]
    rows = [(1, plain), (2, noise + plain), (3, plain + noise), (4, plain[:4096] + noise)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.n_chunks, r.n_bad_chunks > 0, r.kept) for r in compression_quality(docs).collect()}
    assert got == {1: (False, 2, False, True), 2: (False, 3, True, False), 3: (False, 3, True, False), 4: (False, 2, True, False)}


def test_quality_keeps_labelled_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    rows = compression_quality(spark.read.parquet(f"{sf}/documents.parquet").join(good, "doc_id")).where("not base_failed")
    assert rows.where("not kept").count() <= 0.01 * rows.count()


# -- 6 ------------------------------------------------------------------------

def auc(scores, labels):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    pos = labels.sum()
    return (ranks[labels].sum() - pos * (pos + 1) / 2) / (pos * (len(labels) - pos))


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r.toxic == 1 for r in rows]), np.array([r.score for r in rows])
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert auc(s, y) > 0.95
    assert ((s >= 0.5) == y).mean() > 0.95


def test_toxicity_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None), (99, 1), (None, 1)], "doc_id long, toxic int")
    rows = toxicity(awkward, labels).collect()
    assert sorted(r.doc_id for r in rows) == ids(awkward)
    assert all(0 <= r.score <= 1 and r.held_out == (brute.fold(r.doc_id) == 0) for r in rows)
    assert {r.score for r in toxicity(awkward, labels.limit(0)).collect()} == {0.0}
    assert toxicity(empty, labels).count() == 0


# -- 7 ------------------------------------------------------------------------

@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, awkward, empty, k):
    rows = awkward_rows()
    want = brute.near_duplicates(rows, k)
    got = near_duplicates(awkward, shingle=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    if k == 2:
        assert near_duplicates(empty).count() == 0


def test_near_duplicates_in_a_large_group(spark):
    """Many near copies of one text, at all similarities around the threshold, and null and repeated ids."""
    rng = random.Random(21)
    base, rows = prose(150, rng).split(), []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows + [(None, "a b c"), (3, rows[3][1])], "doc_id long, text string")
    want = brute.near_duplicates(rows)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_near_duplicates_cross_without_stars(spark, monkeypatch):
    from feedlens.llm import minhash_dedup as M

    rows = [r for r in awkward_rows() if r[0] in (1, 2, 3, 7, 8, 15)]
    stars = M._stars
    monkeypatch.setattr(M, "_stars", lambda members: stars(members).limit(0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_duplicates(rows)


# -- 8 ------------------------------------------------------------------------

def test_difference_covers():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("window", [13, 4])
def test_substring_dedup(spark, awkward, empty, window):
    def cut(df):
        return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(df, window).collect()),
                      key=str)

    rows = awkward_rows()
    more = rows + [(None, rows[0][1]), (9, rows[8][1]), (1, "other text under a known id " * 3)]
    extra = spark.createDataFrame(more[len(rows):], "doc_id long, text string")
    assert cut(awkward) == sorted(brute.substring_dedup(rows, window), key=str)
    both = awkward.select("doc_id", "text").union(extra)
    assert cut(both) == sorted(brute.substring_dedup(more, window), key=str)
    if window == 13:
        assert cut(empty) == []


# -- 9 ------------------------------------------------------------------------

def test_mixing(spark, awkward, empty, documents):
    for df in (awkward, documents):
        rows = assign(df).collect()
        assert sorted(r.doc_id for r in rows) == ids(df)
        sizes = {}
        for r in rows:
            sizes[r.source] = sizes.get(r.source, 0) + r.size
        want, taken = brute.targets(sizes), dict.fromkeys(sizes, 0)
        texts = dict(pairs(df))
        for r in rows:
            taken[r.source] += r.taken
            assert r.size == len(brute.words(texts[r.doc_id]))
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
            assert r.taken == sum(c.words for c in r.copies) <= MOST * r.size
            assert all(0 <= c.position <= 1 for c in r.copies)
        assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
        again = {r.doc_id: r.copies for r in assign(df.repartition(7)).collect()}
        assert again == {r.doc_id: r.copies for r in rows}
    assert assign(empty).count() == 0 and mix(empty).count() == 0


def test_mix_follows_the_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * 10, f"s{i % 2}") for i in range(4000)], "doc_id long, text string, source string")
    flat, rising = ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 2.0))
    order = mix(docs, weights=(1, 1), budget=1.0, schedules=(flat, rising)).collect()
    assert [r.mix_position for r in order] == sorted(r.mix_position for r in order)
    early = sum(r.source == "s1" and r.mix_position < 0.5 for r in order) / 2000
    assert early == pytest.approx(0.25, abs=0.02)  # the integral of 2t up to 0.5
    assert sum(r.source == "s0" and r.mix_position < 0.5 for r in order) / 2000 == pytest.approx(0.5, abs=0.02)


def test_mix_keeps_every_row(spark):
    """Equal rows, equal ids and null ids are documents each; their words count each time."""
    rows = ([(1, "a b", None, "x")] * 3 + [(1, "a b", None, "y"), (1, "a b", "s", "x"), (1, "other", "s", "x")]
            + [(None, "c", "s", "x")] * 4 + [(None, None, "s", "x"), (2, None, "s", "x"), (3, "d e f", "s", "x")])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    got = assign(docs).collect()
    assert len(got) == len(rows)
    assert {(r.source, r.source_size) for r in got} == {(None, 8), ("s", 2 + 1 + 4 + 3)}
    assert sorted(r.number for r in got if r.doc_id == 1 and r.source is None) == [0, 1, 2, 3]
    # with a budget of the corpus, and no source beyond its own size, everything is taken once
    taken = mix(docs, weights=(1,), budget=1.0, most=1).collect()
    assert sorted(((r.doc_id, r.text, r.source, r.lang) for r in taken), key=str) == sorted(
        (r for r in rows if r[1]), key=str)
    again = mix(docs.repartition(5), weights=(1,), budget=1.0, most=1)
    assert sorted((str(r[:3]), r.mix_words, r.mix_position) for r in again.collect()) == sorted(
        (str(r[:3]), r.mix_words, r.mix_position) for r in taken)
    with pytest.raises(ValueError, match="mix_"):
        mix(docs.withColumn("mix_words", F.lit(1)))


# -- 10 -----------------------------------------------------------------------

def lines(df):
    return sorted(((r.doc_id, r.line_dedup_lines, r.line_dedup_removed, r.text) for r in dedup_lines(df).collect()), key=str)


def test_line_dedup(spark, awkward, empty):
    rows = awkward_rows()
    assert lines(awkward) == sorted(brute.line_dedup(rows), key=str)
    assert dedup_lines(awkward).columns[:len(awkward.columns)] == awkward.columns
    assert lines(empty) == []


def test_line_dedup_near_lines(spark):
    """Lines of frequent words only, lines around every length at which a rule changes, and a large group."""
    rng = random.Random(31)
    common = [f"c{i}" for i in range(14)]
    texts = []
    for _ in range(120):
        texts.append("\n".join(" ".join(rng.sample(common, rng.randint(1, 9))) for _ in range(4)))
    for n in (4, 5, 9, 10, 30, 59, 60, 61, 74, 75, 76, 94, 130):
        base = [f"v{n}_{i}" if i % 3 else f"c{i % 40}x" for i in range(n)]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randint(0, n // 5 + 1)):
                w[rng.randrange(len(w))] = rng.choice(common) if rng.random() < 0.5 else f"n{rng.randrange(999)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines(docs) == sorted(brute.line_dedup(rows), key=str)


def test_line_dedup_splits_a_large_key(spark, monkeypatch):
    """One key with a third of all lines, whose earliest line most of the others do not match."""
    from feedlens.llm import line_dedup as L

    rng = random.Random(41)
    head = "alpha beta " + " ".join(f"h{i}" for i in range(7))
    texts = [head] + [f"alpha beta t1 t2 t3 t4 t5 t6 u{i}" for i in range(200)]
    texts += [f"alpha beta s1 s2 s3 s4 s5 {rng.choice('xyz')}{i % 9} v{i}" for i in range(200)]
    texts += [prose(9, rng).replace("\n", "") for _ in range(200)]
    rows = list(enumerate(texts))
    seen, blocks = [], L._blocks

    def counted(*args):
        sides = blocks(*args)
        seen.extend(max((r["count"] for r in s.groupBy("key", "i", "j").count().collect()), default=0) for s in sides)
        seen.append(args[0].agg(F.max("size")).first()[0])
        return sides

    monkeypatch.setattr(L, "BLOCK", 16)
    monkeypatch.setattr(L, "_blocks", counted)
    assert lines(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(brute.line_dedup(rows), key=str)
    assert seen[2] > 150 and max(seen[:2]) <= 3 * 16


def test_release_gives_back_a_tasks_memory():
    """A worker that waits for its next task kept the hash powers of its largest chunk and freed pages."""
    import pyarrow as pa

    from feedlens.llm import words as W

    assert len(next(W.word_chunks(pa.array(["a b " * 200_000]))).hashes()) == 400_000
    assert len(W._POWERS.up) > 1 << 19
    W.release()
    assert len(W._POWERS.up) == len(W._POWERS.down) == 1
    assert len(next(W.word_chunks(pa.array(["a b"]))).hashes()) == 2


def test_written_bounds_files_and_drops_shuffles(spark, monkeypatch):
    """A table of known size made a file per shuffle partition; shuffle files stayed until frames were collected."""
    from feedlens.llm import tables as T

    monkeypatch.setattr(T, "FILE_ROWS", 100)
    rows = spark.range(0, 400, 1, 16)
    assert T.written(rows, "few", 250).rdd.getNumPartitions() <= 3
    assert len(T.written(rows, "few", 250).inputFiles()) == 3
    assert len(T.written(rows, "all").inputFiles()) == 16
    before = spark.conf.get(T._CLEANUP, None)
    with T.shuffles_dropped(spark):
        assert spark.conf.get(T._CLEANUP) == "true"
    assert spark.conf.get(T._CLEANUP, None) == before


def test_training_tasks_go_by_text(spark, monkeypatch):
    """Each of many small partitions trained alone and sent all parameters."""
    from feedlens.llm import lm_scoring as M

    seen = []
    monkeypatch.setattr(M, "_averaged", lambda rows, like: seen.append(rows.rdd.getNumPartitions()))
    docs = spark.createDataFrame([(i, f"w{i % 7} v{i % 3} u") for i in range(200)], "doc_id long, text string").repartition(40)
    M.score_documents(docs).collect()
    assert seen == [1] * M.ROUNDS
