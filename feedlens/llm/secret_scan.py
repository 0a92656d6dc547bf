"""Secrets in texts: fixed patterns, and random strings found by their token efficiency.

Patterns give the base spans (:data:`PATTERNS`): assignments to names like
``password``, access keys, and long hexadecimal strings.  Matches are the
leftmost ones that do not overlap, kind by kind; a match that is too short is
dropped afterwards and hides what it covers, as the pattern says.

The method adds spans of kind ``random``.  A byte-pair vocabulary knows the
letter groups of language and code, so ordinary strings take three to five
characters a token and random ones less than two.  Each maximal run of
characters of base64 or identifiers (:data:`CANDIDATE`) is cut by a tiktoken
vocabulary, and is random if it has less than ``MAX_RATIO`` characters a token.
Left out before are known digests and identifiers: plain hexadecimal strings
of digest lengths and strings in ``known``, UUIDs, integrity values
(``sha256-...``), numbers and dates, and strings of one class of letters alone,
which words of unknown languages share with random letters.  Runs that overlap
a base span are reported by that span only.

Runs are cut in blocks of ``BLOCK`` characters for the vocabulary, so that the
time is linear for runs of any length; whole runs are judged.

Documents are scanned where Spark reads them, without a shuffle.  The
vocabulary is a file of a public tokenizer, read on the driver and broadcast;
it may have ``MAX_PIECES`` pieces.

Defined cases: null and empty texts have no spans; texts of any length are
scanned whole; each row is scanned by itself, so repeated rows and equal ids
give a row each; other columns are not read.  Positions are code points.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Collection, Iterator
from itertools import chain

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_PIECES = 1_000_000

# Fixed patterns: kind, expression, group and its least length
PATTERNS = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
RANDOM = "random"
KINDS = (*(p[0] for p in PATTERNS), RANDOM)

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
MAX_RATIO = 1.9
BLOCK = 256
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)

# Only letters' case differs in names of assignments; a character class gives the same in either case
_BASE = [(kind, re.compile(p, re.ASCII | re.IGNORECASE if kind == "assign" else 0), group, least)
         for kind, p, group, least in PATTERNS]
_HEX_RUNS = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(CANDIDATE)
_IDENTIFIERS = re.compile(
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"  # UUID
    r"|(?:md5|sha1|sha256|sha384|sha512)-[A-Za-z0-9+/]+={0,2}"                      # integrity value
    r"|[0-9]+(?:[T_/+-][0-9]+)*Z?"                                                  # numbers, dates, ranges
    r"|[^A-Z0-9]+|[^a-z0-9]+")                                                      # letters of one case
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
# How tiktoken cuts a run before it joins pieces: letters, digits, the rest
_CUT = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches; kinds as numbered in ``KINDS``."""
    out = []
    for k, (kind, pattern, group, least) in enumerate(_BASE):
        # the matches of hex are maximal runs, so that short ones needn't be looked at
        for m in (_HEX_RUNS if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, m.end()))
    return out


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The pieces of a tiktoken file and their ranks."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}
    if not 0 < len(ranks) <= MAX_PIECES:
        raise ValueError(f"a vocabulary must have 1 to {MAX_PIECES} pieces")
    return ranks


def encoding(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    return tiktoken.Encoding("pieces", pat_str=_CUT, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str, known: Collection[str] = ()) -> bool:
    """Whether a run is a digest or an identifier and no secret."""
    return (run in known or _IDENTIFIERS.fullmatch(run) is not None
            or (len(run) in DIGEST_LENGTHS and _DIGEST.fullmatch(run) is not None))


def is_random(run: str, pieces: tiktoken.Encoding, max_ratio: float = MAX_RATIO) -> bool:
    n = sum(len(pieces.encode_ordinary(run[i:i + BLOCK])) for i in range(0, len(run), BLOCK))
    return len(run) < max_ratio * n


def spans(text: str, pieces: tiktoken.Encoding, max_ratio: float = MAX_RATIO,
          known: Collection[str] = ()) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, by start and kind."""
    out, added = base_spans(text), []
    taken, i, reach = sorted(out), 0, 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while i < len(taken) and taken[i][0] < end:
            reach, i = max(reach, taken[i][2]), i + 1
        if reach <= start and not is_known(m.group(), known) and is_random(m.group(), pieces, max_ratio):
            added.append((start, len(KINDS) - 1, end))
    return sorted(out + added)


SPAN = "struct<kind:string,start:bigint,end:bigint>"


def _scan(docs: DataFrame, fn, columns: list[str], schema: str, vocabulary: str, max_ratio: float,
          known: Collection[str]) -> DataFrame:
    """``fn(batch, spans of each text)`` gives the new columns of a batch."""
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(vocabulary), frozenset(known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, left_out = shared.value
        pieces = encoding(ranks)
        for batch in batches:
            found = [spans(t, pieces, max_ratio, left_out) if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(fn(batch, found))

    return docs.select(*columns).mapInArrow(run, schema)


def scan_secrets(docs: DataFrame, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO,
                 known: Collection[str] = ()) -> DataFrame:
    """Per document row: doc_id and spans, an array of (kind, start, end) by start, then kind as in ``KINDS``."""
    def columns(batch, found):
        flat = list(chain.from_iterable(found))
        at = [0]
        for f in found:
            at.append(at[-1] + len(f))
        items = pa.StructArray.from_arrays(
            [pa.array([KINDS[k] for _, k, _ in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int64()),
             pa.array([e for _, _, e in flat], pa.int64())], ["kind", "start", "end"])
        return {"doc_id": batch.column("doc_id"), "spans": pa.ListArray.from_arrays(pa.array(at, pa.int32()), items)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _scan(docs, columns, ["doc_id", "text"], f"doc_id {kind}, spans array<{SPAN}>", vocabulary, max_ratio, known)


def redacted(text: str, found: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with each stretch that spans cover replaced by ``mark``."""
    out, reach = [], 0
    for start, _, end in found:
        if start >= reach:
            out += [text[reach:start], mark]
        reach = max(reach, end)
    return "".join(out) + text[reach:]


def redact_secrets(docs: DataFrame, mark: str = "<secret>", vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO,
                   known: Collection[str] = ()) -> DataFrame:
    """Per document row: doc_id, the text with its secrets replaced by ``mark`` (null stays null), and their number."""
    def columns(batch, found):
        texts = [t and redacted(t, f, mark) for t, f in zip(batch.column("text").to_pylist(), found)]
        return {"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string()),
                "n_secrets": pa.array([len(f) for f in found], pa.int64())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _scan(docs, columns, ["doc_id", "text"], f"doc_id {kind}, text string, n_secrets long", vocabulary, max_ratio,
                 known)


def listed(items) -> F.Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
