"""Words, windows and hashes of a whole Arrow string column at once.

All text operators of this package tokenise here, in numpy, over the UTF-8
bytes of an Arrow batch.  Work goes in chunks of whole documents of about
``CHUNK_BYTES`` bytes, so memory is bounded by the chunk (or by one document).
Null text counts as empty.  Hashes are 64 bit and do not depend on the batch,
the chunk or the machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

_U = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15  # 2**64 / golden ratio, odd


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multiplications), element by element."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_GOLDEN) + _U(salt)) | _U(1)


_BYTE_VALUE = seeds(256, 11)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, _U)
        self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(n - 1, 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, _U(base & (2**64 - 1)))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


    def drop(self) -> None:
        self.__init__()


_POWERS = _Powers()


def release() -> None:
    """Gives back what a task's work has left in the process: idle workers stay beside those that go on."""
    _POWERS.drop()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Bytes of words: everything but ASCII white space.
PLAIN = ~_SPACE
# Bytes of words: a-z, 0-9 and all of any non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """The words of some documents: document i has words ``ptr[i]:ptr[i + 1]``."""

    data: np.ndarray      # the documents' bytes
    offsets: np.ndarray   # byte range of each document in data
    starts: np.ndarray    # byte range of each word in data
    ends: np.ndarray
    ptr: np.ndarray
    first: int            # index in the batch of the first document here

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        up, down = _POWERS.upto(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, _U)
        np.cumsum(_BYTE_VALUE[self.data] * up[: len(self.data)], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix(h + (self.ends - self.starts).astype(_U) * _U(_GOLDEN))

    def left(self) -> np.ndarray:
        """How many words of the same document begin at each word, itself included."""
        return np.repeat(self.ptr[1:], self.counts) - np.arange(len(self.starts))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` values from each position on; the last ``k - 1`` positions are absent."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for j, c in enumerate(seeds(k, 1000 + k)):
        out += hashes[j:j + n] * c
    return mix(out)


def string_column(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    if not (wide or pa.types.is_string(arr.type)):
        arr, wide = arr.cast(pa.large_string()), True
    _, offsets, data = arr.buffers()
    if offsets is None or len(arr) == 0:
        return np.zeros(len(arr) + 1, np.int64), np.zeros(0, np.uint8)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o.astype(np.int64), d


def split_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes, one document at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, first: int = 0) -> Words:
    """Words are the longest runs, inside one document, of the bytes that ``table`` marks."""
    inside = table[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), first)


def word_chunks(arr: pa.Array, table: np.ndarray = PLAIN, lower: bool = False,
                limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a string column, chunk by chunk, in order."""
    offsets, data = string_column(arr)
    for i, j in split_chunks(offsets, limit):
        part = data[offsets[i]:offsets[j]]
        yield find_words(_LOWER[part] if lower else part, offsets[i:j + 1] - offsets[i], table, i)


def count_words(arr: pa.Array, table: np.ndarray = PLAIN) -> np.ndarray:
    """Number of words of each string."""
    parts = [w.counts for w in word_chunks(arr, table)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def order_within(values: np.ndarray, groups: np.ndarray, used: int = 64) -> np.ndarray:
    """The order by group, and by value within a group; ``used`` low bits of the values count.

    Sorts one 64-bit number a row, group above and the value's upper bits below
    it, which is several times faster than a sort by two keys; that is used
    where the upper bits of different values of a group are equal.
    """
    if len(values) < 2:
        return np.arange(len(values))
    bits = max(1, int(groups.max()).bit_length())
    key = groups.astype(_U) << _U(64 - bits) | values << _U(64 - used) >> _U(bits)
    order = np.argsort(key)
    key, v = key[order], values[order]
    if ((key[1:] == key[:-1]) & (v[1:] != v[:-1])).any():
        return np.lexsort((values, groups))
    return order


def distinct_per_doc(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each document: values sorted within documents, and their documents."""
    order = order_within(values, docs)
    v, d = values[order], docs[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[fresh], d[fresh]


def list_column(values: np.ndarray, ptr: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column out of one flat array and the rows' bounds in it."""
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(values, type=kind))
