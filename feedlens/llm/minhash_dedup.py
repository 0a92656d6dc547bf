"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full sets.

A document's set holds its distinct shingles of ``shingle`` consecutive words
(ASCII lower case, split at ASCII white space); with fewer words the whole
sequence is the one shingle; without words the set is empty and links with
nothing.  Documents are linked if the Jaccard similarity of their full sets is
at least ``percent`` / 100; a group is what links connect.

Tensored banding: instead of one independent band of minhashes for each of
many tables, two small collections of sub-bands are computed, and a table's
key combines one sub-band of each.  ``LEFT`` x ``RIGHT`` tables need only
(LEFT + RIGHT) sub-bands.  A pair of similarity s shares a table with
probability (1 - (1 - s**2)**LEFT) * (1 - (1 - s**3)**RIGHT): 0.9996 at 0.8,
above 0.99999 at 0.9.

Documents with equal sets are one node from the start.  In each table's
bucket, the smallest node and the first in each of ``ORDERS`` hash orders are
compared with every other (stars, linear in the bucket).  Only where a bucket still holds several groups
after that, its nodes of different groups are compared pairwise, if they are at most
``CROWD``.  In buckets of more, which grow with the corpus where short texts share
a passage, nodes are compared that share a shingle among the rarest ones of either
(their prefixes): similar sets do, so this loses nothing, and the shared passage is
in no prefix.  Full sets are
fetched for pairs that three tests allow: their sizes; the parity of their
shingles on ``PARITY`` bits (sets differ in at least as many shingles as their
parities differ in bits, so this loses nothing); and their minhashes, of which
a pair at the threshold shares 41.6 of 52 on average with a deviation of 2.9,
and must share ``AGREE``.

Defined cases: rows with a null doc_id take no part and come back kept, with a
null component; rows that repeat a doc_id are one document; ties go to the smaller
doc_id; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import BitFilter, Held, components, longs, map_arrow, written

LEFT, LEFT_ROWS = 8, 2
RIGHT, RIGHT_ROWS = 12, 3
HASHES = LEFT * LEFT_ROWS + RIGHT * RIGHT_ROWS  # 52
AGREE = 24
PARITY = 512
ORDERS = 3
CROWD = 64  # nodes of a bucket up to which all are compared with all
PACKED = (HASHES + 7) // 8  # minhashes, one byte each, in longs
KEY_BITS = 25   # 4 MB broadcast, whatever the data
NODE_BITS = 23  # 1 MB

_MULTIPLY = W.seeds(HASHES, 77)
_ADD = W.seeds(HASHES, 78)


def shingle_sets(w: W.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document, and the bounds of each set."""
    h = w.hashes()
    whole = np.flatnonzero(w.left() >= k)
    values, docs = W.windows(h, k)[whole], w.doc_of_word()[whole]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        own = np.array([_sequence(h[w.ptr[d]:w.ptr[d + 1]]) for d in short], np.uint64)
        values, docs = np.concatenate([values, own]), np.concatenate([docs, short])
        order = np.argsort(docs, kind="stable")
        values, docs = values[order], docs[order]
    values, docs = W.distinct_per_doc(values, docs)
    return values, np.searchsorted(docs, np.arange(w.n_docs + 1))


def _sequence(h: np.ndarray) -> np.uint64:
    return W.mix(W.windows(h, len(h)) + np.uint64(len(h)))[0]


def signatures(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Minhashes (documents x HASHES) of non-empty sets."""
    out = np.empty((len(ptr) - 1, HASHES), np.uint32)
    for j in range(HASHES):
        x = values * _MULTIPLY[j] + _ADD[j]
        out[:, j] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), ptr[:-1])
    return out


def sub_bands(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sub-bands of the two collections, hashed (documents x LEFT and documents x RIGHT)."""
    def bands(part, rows, salt):
        out = np.zeros((len(part), part.shape[1] // rows), np.uint64)
        for r, c in enumerate(W.seeds(rows, salt)):
            out += part[:, r::rows].astype(np.uint64) * c
        return W.mix(out + W.seeds(out.shape[1], salt + 1))

    cut = LEFT * LEFT_ROWS
    return bands(sig[:, :cut], LEFT_ROWS, 500), bands(sig[:, cut:], RIGHT_ROWS, 600)


def table_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The key of each table: every sub-band of one collection with every one of the other."""
    return W.mix(left[:, :, None] * np.uint64(3) + right[:, None, :]).reshape(len(left), LEFT * RIGHT)


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, hash of doc_id) of the rows that have a doc_id."""
    return (docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .withColumn("h", _id_hash("doc_id")))


def _id_hash(c: str):
    return F.xxhash64(F.col(c).cast("long"))


def _set_hashes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set1, set2) of every row; equal sets have equal hashes."""
    def emit(batch):
        ids = batch.column(0)
        for w in W.word_chunks(batch.column(1), lower=True):
            values, ptr = shingle_sets(w, k)
            full = np.flatnonzero(np.diff(ptr))
            one, two = np.zeros(w.n_docs, np.uint64), np.zeros(w.n_docs, np.uint64)
            if len(full):
                one[full] = np.add.reduceat(W.mix(values), ptr[full])
                two[full] = np.bitwise_xor.reduceat(W.mix(values + np.uint64(12345)), ptr[full])
            yield {"doc_id": ids.slice(w.first, w.n_docs), "n_shingles": pa.array(np.diff(ptr).astype(np.int64)),
                   "set1": longs(one), "set2": longs(two)}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), emit,
                     "doc_id long, n_shingles long, set1 long, set2 long")


def _some(docs: DataFrame, wanted: BitFilter, inside: bool, emit, schema: str) -> DataFrame:
    """``emit(ids, words)`` over the documents that (do not) pass a filter of doc_ids; empty ones are left out."""
    def run(batch):
        rows = np.flatnonzero(wanted.hits(batch.column(2).to_numpy().view(np.uint64)) == inside)
        if len(rows):
            ids = batch.column(0).to_numpy()[rows]
            for w in W.word_chunks(batch.column(1).take(pa.array(rows)), lower=True):
                yield from emit(ids[w.first:w.first + w.n_docs], w)

    return map_arrow(_texts(docs), run, schema)


_MARKS = [f"m{i}" for i in range(PACKED)] + [f"p{i}" for i in range(PARITY // 64)]


def parities(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Of each set, for each of PARITY bits, whether an odd number of its values falls there: as longs."""
    docs = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    at = docs * PARITY + (values >> np.uint64(17)).astype(np.int64) % PARITY
    odd = np.bincount(at, minlength=(len(ptr) - 1) * PARITY) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, PARITY), axis=1).view(np.int64)


def _sketches(docs: DataFrame, copies: BitFilter, inside: bool, k: int) -> DataFrame:
    """(node, n, keys, bands, m0 ..): table keys, sub-bands and packed minhashes of non-empty sets."""
    def emit(ids, w):
        values, ptr = shingle_sets(w, k)
        full = np.flatnonzero(np.diff(ptr))
        if not len(full):
            return
        bounds = np.append(ptr[full], len(values))
        sig = signatures(values, bounds)
        packed = np.zeros((len(full), PACKED * 8), np.uint8)
        packed[:, :HASHES] = sig & np.uint32(0xFF)
        packed = np.hstack([packed.view(np.int64), parities(values, bounds)])
        left, right = sub_bands(sig)
        bands = (np.hstack([left, right]) >> np.uint64(32)).astype(np.uint32).reshape(-1).view(np.int32)
        rows = np.arange(len(full) + 1)
        yield {"node": pa.array(ids[full]), "n": pa.array(np.diff(ptr)[full].astype(np.int64)),
               "keys": W.list_column(table_keys(left, right).reshape(-1).view(np.int64), rows * (LEFT * RIGHT), pa.int64()),
               "bands": W.list_column(bands, rows * (LEFT + RIGHT), pa.int32()),
               **{m: pa.array(np.ascontiguousarray(packed[:, i])) for i, m in enumerate(_MARKS)}}

    schema = "node long, n long, keys array<long>, bands array<int>" + "".join(f", {m} long" for m in _MARKS)
    return _some(docs, copies, inside, emit, schema)


def _full_sets(docs: DataFrame, nodes: DataFrame, k: int, held: Held) -> DataFrame:
    """(node, values): the full sets of ``nodes``."""
    def emit(ids, w):
        values, ptr = shingle_sets(w, k)
        yield {"node": pa.array(ids),
               "values": pa.LargeBinaryArray.from_buffers(
                   pa.large_binary(), w.n_docs,
                   [None, pa.py_buffer((ptr * 8).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())}

    wanted = BitFilter(nodes.select(_id_hash("node").alias("h")), "h", NODE_BITS)
    return held(_some(docs, wanted, True, emit, "node long, values binary")
                .join(nodes, "node", "left_semi").dropDuplicates(["node"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    def emit(batch):
        ok = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x = np.frombuffer(x.as_buffer(), np.uint64)
            y = np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= percent * (len(x) + len(y) - both))
        keep = pa.array(ok)
        yield {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    joined = (pairs.join(sets.select(F.col("node").alias("a"), F.col("values").alias("x")), "a")
              .join(sets.select(F.col("node").alias("b"), F.col("values").alias("y")), "b"))
    return map_arrow(joined.select("a", "b", "x", "y"), emit, "a long, b long")


def _agreeing(a: str, b: str):
    """How many packed minhashes of two rows agree (bytes of zero in their difference)."""
    total = None
    for i in range(PACKED):
        x = F.col(f"{a}.m{i}").bitwiseXOR(F.col(f"{b}.m{i}"))
        for s in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
        total = differ if total is None else total + differ
    return F.lit(HASHES) - total


def _possible(a: str, b: str, percent: int):
    """Whether sizes, parities and minhashes of two rows allow the similarity."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}"))) for i in range(PARITY // 64)), F.lit(0))
    return ((F.least(x, y) * 100 >= F.greatest(x, y) * percent)
            & (differ * (100 + percent) <= (x + y) * (100 - percent)) & (_agreeing(a, b) >= AGREE))


def _stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of every node and the heads of its buckets: the first in a few orders that all buckets share.

    As the orders are shared, the many buckets of one large group have few different heads.
    """
    orders = [F.min("node"), *[F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(ORDERS)]]
    heads = (members.groupBy("key").agg(*[o.alias(f"head{i}") for i, o in enumerate(orders)])
             .select("key", F.explode(F.array_distinct(F.array(*[f"head{i}" for i in range(ORDERS + 1)]))).alias("head")))
    return (members.select("key", "node").join(heads, "key").where("node <> head")
            .select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct())


def _crossing(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket, are in different groups and may be similar.

    Two nodes share table (i, j) if they share sub-bands i and j, so a pair is
    made only in the table of the first sub-bands that they share.
    """
    x, y = members.alias("x"), members.alias("y")
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.group") < F.col("y.group")) & _possible("x", "y", percent)
    for at, n, skip in ((F.expr(f"x.t div {RIGHT}"), LEFT, 0), (F.expr(f"x.t % {RIGHT}"), RIGHT, LEFT)):
        for i in range(n - 1):
            on &= (at <= i) | (F.col("x.bands")[skip + i] != F.col("y.bands")[skip + i])
    return x.join(y, on).select(F.least("x.node", "y.node").alias("a"),
                                F.greatest("x.node", "y.node").alias("b")).distinct()


def _prefixes(docs: DataFrame, crowd: DataFrame, k: int, percent: int, rows: int) -> DataFrame:
    """(node, v): the shingles of each node of ``crowd`` of which a similar set has one, rare ones first.

    Sets of which ``percent`` is shared share one of the first n - ceil(percent * n / 100) + 1 of either, in any common
    order; here shingles are ordered by how many sets of ``crowd`` have them.  What one set alone has is left out.
    """
    def emit(ids, w):
        values, ptr = shingle_sets(w, k)
        full = np.flatnonzero(np.diff(ptr))
        if len(full):
            bounds = np.append(ptr[full], len(values))
            yield {"node": pa.array(ids[full]), "s": longs(np.add.reduceat(W.mix(values), ptr[full])),
                   "values": W.list_column(values.view(np.int64), bounds, pa.int64())}

    wanted = BitFilter(crowd.select(_id_hash("node").alias("h")), "h", NODE_BITS)
    sets = written(_some(docs, wanted, True, emit, "node long, s long, values array<long>")
                   .join(crowd.select("node"), "node", "left_semi").dropDuplicates(["node", "s"]), "crowd-sets", rows)
    one = sets.select("node", "s", F.size("values").alias("n"), F.explode("values").alias("v"))
    shared = one.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ordered = one.join(shared, "v").groupBy("node", "s", "n").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("o"))
    # the set's own shingles come before all shared ones
    left = F.expr(f"n - (n * {percent} + 99) div 100 + 1 - (n - size(o))").cast("int")
    return (ordered.where(left > 0).select("node", F.explode(F.slice("o", F.lit(1), left)).alias("x"))
            .select("node", "x.v").distinct())


def _crowded(docs: DataFrame, crowd: DataFrame, marks: DataFrame, k: int, percent: int, rows: int) -> DataFrame:
    """Pairs (a, b) of the nodes of ``crowd`` (node, group) in different groups that may be similar."""
    known = _prefixes(docs, crowd, k, percent, rows).join(crowd, "node").join(marks, "node")
    x, y = known.alias("x"), known.alias("y")
    # both sides are plain exchanges, so a shingle of very many prefixes is split
    on = (F.col("x.v") == F.col("y.v")) & (F.col("x.group") < F.col("y.group")) & _possible("x", "y", percent)
    return x.join(y, on).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80) -> DataFrame:
    """Per document row (doc_id, n_shingles, component_id, kept)."""
    held = Held()
    own = held(_set_hashes(docs, shingle))
    n_docs = own.count()
    own = written(own, "set-hashes", n_docs)
    held.drop()
    filled, same_set = own.where("n_shingles > 0 and doc_id is not null"), ["set1", "set2", "n_shingles"]
    classes = written(filled.groupBy(*same_set).agg(F.min("doc_id").alias("node")), "classes", n_docs)
    copies = written(filled.join(classes, same_set).where("doc_id <> node").select("doc_id", "node").distinct(),
                     "copies", n_docs)

    # rows that may be copies are compared with the list of copies; all others are nodes where they stand
    flagged = BitFilter(copies.select(_id_hash("doc_id").alias("h")), "h", NODE_BITS)
    maybe = _sketches(docs, flagged, True, shingle).join(copies.select(F.col("doc_id").alias("node")), "node", "left_anti")
    nodes = held(_sketches(docs, flagged, False, shingle).union(maybe))

    keys = (nodes.select("node", F.explode("keys").alias("key")).groupBy("key")
            .agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key"))
    shared = BitFilter(keys, "key", KEY_BITS)

    def keep_shared(batch):
        lists = batch.column(1)
        keys = lists.flatten().to_numpy().view(np.uint64)
        hit = shared.hits(keys)
        node = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy())
        t = np.tile(np.arange(LEFT * RIGHT, dtype=np.int32), len(lists))
        yield {"node": pa.array(node[hit]), "t": pa.array(t[hit]), "key": longs(keys[hit])}

    # a few keys that only one node has pass the filter too; they make no pairs
    members = held(map_arrow(nodes.select("node", "keys"), keep_shared, "node long, t int, key long"))
    info = nodes.select("node", F.struct("n", *_MARKS).alias("x"))

    links, n_links, groups = None, 0, None
    for crossing in (False, True):
        now = members.withColumn("group", F.col("node")) if groups is None else (
            members.join(groups.withColumnRenamed("component", "group"), "node", "left")
            .withColumn("group", F.coalesce("group", "node")))
        open_keys = (now.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi"))
                     .where("lo < hi").select("key"))
        n_members = members.count()
        members = written(now.join(open_keys, "key", "left_semi"), "members", n_members)
        if crossing:
            crowds = written(members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CROWD).select("key"),
                             "crowds", n_members)
            if crowds.isEmpty():
                pairs = _crossing(members.join(nodes.drop("keys"), "node"), percent)
            else:
                crowd = written(members.join(crowds, "key", "left_semi").select("node", "group").distinct(), "crowd", n_members)
                pairs = (_crossing(members.join(crowds, "key", "left_anti").join(nodes.drop("keys"), "node"), percent)
                         .union(_crowded(docs, crowd, nodes.select("node", "n", *_MARKS), shingle, percent, n_docs)).distinct())
        else:
            pairs = (_stars(members).join(info.withColumnRenamed("node", "a"), "a")
                     .join(info.select(F.col("node").alias("b"), F.col("x").alias("y")), "b")
                     .where(_possible("x", "y", percent)).select("a", "b"))
        found = held(pairs)
        n_pairs = found.count()
        pairs = written(found, "pairs", n_pairs)
        held.drop(found)
        if n_pairs:  # without a pair of stars, buckets still cross, each node its own group
            asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
            sets = _full_sets(docs, asked, shingle, held)
            similar = held(_confirmed(pairs, sets, percent))
            similar.count()
            found = written(similar, "links", n_pairs)
            held.drop(sets, similar)
            links, n_links = (found, n_pairs) if links is None else (links.union(found), n_links + n_pairs)
            groups = components(links, rows=n_links)
        members = members.drop("group")

    held.drop()  # what follows is read from written tables
    node = F.coalesce("node", "doc_id")
    group = (own.select("doc_id").distinct().join(copies.groupBy("doc_id").agg(F.min("node").alias("node")), "doc_id", "left")
             .select("doc_id", node.alias("node")))
    if groups is not None:
        group = group.join(groups, "node", "left").select("doc_id", F.coalesce("component", "node").alias("node"))
    return (own.select("doc_id", "n_shingles")
            .join(group.withColumnRenamed("node", "component_id"), "doc_id", "left")
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
