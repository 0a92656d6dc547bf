"""Quality rules: compression bands.

The zstandard ratio (compressed over plain bytes) of a whole text, and of its
fixed chunks (the last one ends with the text, and may overlap the one before;
shorter texts than a chunk have none), must lie in a band that depends on the length: below it, a text
repeats itself; above it, it is noise, keys or encoded data.  Short texts
compress badly by nature, so their bands are wider and the shortest have none.

Base counts over words ``[^\\x20\\x09-\\x0D]+``: word_chars (code points in
words), n_symbols (characters of ``#*$%&|<>``), n_dup_lines (lines with a word,
split at newlines, equal to an earlier line), n_repeat_words (words in 3-word
windows found twice or more in the text, the first included).  A text fails
the base rules below ``MIN_WORDS`` words, or if more than half of its words
are repeat words.

Defined cases: null and empty text have no words, zero counts and fail; other
columns, whatever their names, are not read; each row is judged on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import words as W
from .tables import map_arrow

MIN_WORDS = 50
LEVEL = 3
CHUNK = 4096
# (texts below so many bytes, lowest ratio, highest ratio)
BANDS = ((256, 0.0, 9.0), (512, 0.50, 0.90), (1024, 0.46, 0.80), (2048, 0.43, 0.72), (4096, 0.41, 0.66),
         (8192, 0.39, 0.62), (16384, 0.375, 0.60), (131072, 0.36, 0.60), (1 << 62, 0.26, 0.60))
CHUNK_BAND = (0.37, 0.62)
MAX_BAD_CHUNKS = 0.25  # share of the chunks that may lie outside CHUNK_BAND

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _within(doc: np.ndarray, counts_at: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=counts_at, minlength=n).astype(np.int64)


def repeat_words(w: W.Words, h: np.ndarray, k: int = 3) -> np.ndarray:
    """Words per document that lie in a k-word window found twice or more in it."""
    whole = np.flatnonzero(w.left() >= k)
    values, docs = W.windows(h, k)[whole], w.doc_of_word()[whole]
    order = W.order_within(values, docs)
    v, d = values[order], docs[order]
    same = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(v), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(h) + 1, np.int64)
    at = whole[order[twice]]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return _within(w.doc_of_word(), np.cumsum(edge)[:-1] > 0, w.n_docs)


def duplicate_lines(w: W.Words) -> np.ndarray:
    """Lines per document with a word, equal (all bytes) to an earlier line of it."""
    # a line is a "word" of bytes that are not newlines; empty lines vanish
    lines = W.find_words(w.data, w.offsets, _NOT_NEWLINE)
    first_word = np.searchsorted(w.starts, lines.starts)
    has_word = np.append(w.starts, len(w.data) + 1)[first_word] < lines.ends
    values, docs = lines.hashes()[has_word], lines.doc_of_word()[has_word]
    _, distinct = W.distinct_per_doc(values, docs)
    return np.bincount(docs, minlength=w.n_docs) - np.bincount(distinct, minlength=w.n_docs)


_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[0x0A] = False


def band_for(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    return next((lo, hi) for below, lo, hi in bands if n_bytes < below)


def ratios(text: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, np.ndarray]:
    """The ratio of the whole text and of each chunk; every byte of a text of a chunk or more is in one."""
    whole = len(packer.compress(text)) / len(text) if text else 1.0
    starts = list(range(0, len(text) - CHUNK + 1, CHUNK))
    if starts and len(text) % CHUNK:
        starts.append(len(text) - CHUNK)
    parts = [len(packer.compress(text[i:i + CHUNK])) / CHUNK for i in starts]
    return whole, np.array(parts)


def in_bands(n_bytes: int, whole: float, parts: np.ndarray) -> bool:
    lo, hi = band_for(n_bytes)
    bad = ((parts < CHUNK_BAND[0]) | (parts > CHUNK_BAND[1])).sum()
    return lo <= whole <= hi and bad <= MAX_BAD_CHUNKS * len(parts)


_RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, ratio double, n_chunks long, n_bad_chunks long, kept boolean")


def compression_quality(docs: DataFrame) -> DataFrame:
    """Per document the base counts, the ratios and the verdict ``kept``."""
    def emit(batch):
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for w in W.word_chunks(batch.column(1)):
            h, owner, n = w.hashes(), w.doc_of_word(), w.n_docs
            begins = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])  # code points
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL[w.data])])
            repeat = repeat_words(w, h)
            failed = (w.counts < MIN_WORDS) | (100 * repeat > 50 * w.counts)
            whole, chunks, bad, kept = np.empty(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
            for i, (o, e) in enumerate(zip(w.offsets[:-1], w.offsets[1:])):
                whole[i], parts = ratios(w.data[o:e].tobytes(), packer)
                chunks[i] = len(parts)
                bad[i] = ((parts < CHUNK_BAND[0]) | (parts > CHUNK_BAND[1])).sum()
                kept[i] = not failed[i] and in_bands(e - o, whole[i], parts)
            yield {
                "doc_id": batch.column(0).slice(w.first, n),
                "n_words": pa.array(w.counts.astype(np.int64)),
                "word_chars": pa.array(_within(owner, begins[w.ends] - begins[w.starts], n)),
                "n_symbols": pa.array((symbols[w.offsets[1:]] - symbols[w.offsets[:-1]]).astype(np.int64)),
                "n_dup_lines": pa.array(duplicate_lines(w).astype(np.int64)),
                "n_repeat_words": pa.array(repeat),
                "base_failed": pa.array(failed), "ratio": pa.array(whole),
                "n_chunks": pa.array(chunks), "n_bad_chunks": pa.array(bad), "kept": pa.array(kept),
            }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), emit, f"doc_id {kind}, {_RESULT}")
