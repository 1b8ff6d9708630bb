"""Columnar text kernels shared by the corpus operators (numpy over Arrow buffers).

A batch of texts is looked at as one byte array cut into chunks of whole
documents.  Words are maximal runs of bytes other than the six ASCII white
space bytes (``[^\\x20\\x09-\\x0D]+``); since every byte of a multi-byte UTF-8
character is above 0x7F, byte runs and code point runs are the same.

A span's hash takes its bytes eight at a time through a finalizer, in two lanes
of 64 bits; spans above ``LONG`` bytes take a cryptographic digest.  Where a
result must not rest on hashes at all, ``Chunk.codes`` compares the bytes of
spans whose hashes agree.  ``Chunk.rolling`` hashes the windows of one width at
every byte, modulo 2**64; unequal windows may share such a hash, so it only
deals into buckets whose content is compared afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document forms a chunk of its own.
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LANE = np.uint64(0xA24BAED4963EE407)
#: Bytes from which a span's hash is a digest of its own.
LONG = 64
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)

IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> _S)
    x = x * _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_powers: tuple[np.ndarray, np.ndarray] = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first ``n`` powers of the base and of its inverse, modulo 2**64."""
    global _powers
    have = _powers
    if len(have[0]) < n:
        made = []
        for step in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(max(n, CHUNK_BYTES + 1), step, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        have = made[0], made[1]
        if n <= 4 * CHUNK_BYTES:  # those of a longer text are not kept
            _powers = have
    return have[0][:n], have[1]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents, each of at most ``limit`` bytes or one document."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Chunk:
    """Words of some documents: ``starts``/``ends`` byte positions; ``first[d]`` the index of document d's first word.

    With ``lower`` the letters A-Z count as a-z in every hash and comparison; ``data`` stays as it is.  ``is_word``
    holds for the bytes that words are made of.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, is_word: np.ndarray = IS_WORD):
        self.data, self.off = data, offsets - offsets[0]
        word = is_word[data]
        self.is_word = word
        before = np.empty_like(word)
        if len(word):
            before[0] = False
            before[1:] = word[:-1]
            cut = self.off[:-1]
            before[cut[cut < len(word)]] = False
        self.starts = np.flatnonzero(word & ~before)
        after = np.empty_like(word)
        if len(word):
            after[-1] = False
            after[:-1] = word[1:]
            last = self.off[1:] - 1
            after[last[last >= 0]] = False
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, self.off)
        self.lower = lower
        self._padded: np.ndarray | None = None

    @property
    def n_docs(self) -> int:
        return len(self.off) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self, first: np.ndarray | None = None) -> np.ndarray:
        first = self.first if first is None else first
        return np.repeat(np.arange(self.n_docs), np.diff(first))

    @property
    def padded(self) -> np.ndarray:
        """The bytes as they count, and eight zeros."""
        if self._padded is None:
            self._padded = np.zeros(len(self.data) + 8, np.uint8)
            self._padded[: len(self.data)] = LOWER[self.data] if self.lower else self.data
        return self._padded

    def _eight(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Up to eight bytes from each position, as one number."""
        every = np.ndarray((len(self.data) + 1,), "<u8", self.padded, strides=(1,))
        return every[at] & _KEEP[np.minimum(left, 8)]

    def lanes(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that tell the bytes of each span."""
        size = ends - starts
        block = self._eight(starts, size)
        a = mix(block + size.astype(np.uint64) * _BASE)
        b = mix(block * _LANE ^ size.astype(np.uint64))
        alive, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(alive):
            block = self._eight(starts[alive] + k, size[alive] - k)
            a[alive] = mix(a[alive] * _BASE ^ block)
            b[alive] = mix(b[alive] + block * _LANE)
            k += 8
            alive = alive[size[alive] > k]
        long = np.flatnonzero(size > LONG)
        if len(long):
            raw = memoryview(self.padded)
            found = b"".join(hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(starts[long].tolist(), ends[long].tolist()))
            a[long], b[long] = np.frombuffer(found, np.uint64).reshape(-1, 2).T
        return a, b

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte span."""
        a, b = self.lanes(starts, ends)
        return mix(a ^ (b >> np.uint64(7)) * _M1)

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def codes(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code of each span, a span of each code): codes are equal exactly where the bytes are."""
        _, at, code = np.unique(self.span_hash(starts, ends), return_index=True, return_inverse=True)
        other = at[code]
        size = ends - starts
        same = size == size[other]
        alive, k = np.flatnonzero(same & (other != np.arange(len(other)))), 0
        while len(alive) and k <= LONG:
            left = size[alive] - k
            equal = self._eight(starts[alive] + k, left) == self._eight(starts[other[alive]] + k, left)
            same[alive[~equal]] = False
            k += 8
            alive = alive[equal & (left > 8)]
        raw = memoryview(self.padded)
        for i in alive.tolist():
            j = int(other[i])
            same[i] = raw[starts[i] : ends[i]] == raw[starts[j] : ends[j]]
        if not same.all():  # unequal spans of one hash: by the bytes themselves
            found: dict[bytes, int] = {}
            code = np.fromiter((found.setdefault(bytes(raw[s:e]), len(found)) for s, e in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
            at = np.unique(code, return_index=True)[1]
        return code, at

    def word_codes(self) -> tuple[np.ndarray, np.ndarray]:
        return self.codes(self.starts, self.ends)

    def rolling(self, width: int) -> np.ndarray:
        """A bucket number for the ``width`` bytes from each position; equal bytes share it, unequal ones may."""
        data = self.padded[: len(self.data)]
        up, down = _pow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
        return mix((sums[width:] - sums[:-width]) * down[: max(0, len(data) - width + 1)])

    def count(self, table: np.ndarray) -> np.ndarray:
        """Per document: bytes for which ``table`` holds."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(table[self.data], out=total[1:])
        return np.diff(total[self.off])


def each(column: pa.Array, lower: bool, limit: int = CHUNK_BYTES, is_word: np.ndarray = IS_WORD) -> Iterator[tuple[int, int, Chunk]]:
    data, offsets = flat(column)
    for a, b in chunks(offsets, limit):
        yield a, b, Chunk(data[offsets[a] : offsets[b]], offsets[a : b + 1], lower, is_word)


_WEIGHTS = mix(np.arange(11, 43, dtype=np.uint64)) | np.uint64(1)


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes; the caller cuts at document ends."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    out = words[:m] * _WEIGHTS[0]
    for k in range(1, n):
        out = out + words[k : k + m] * _WEIGHTS[k]
    return mix(out)


def distinct_per_doc(docs: np.ndarray, codes: np.ndarray, n_docs: int) -> np.ndarray:
    """Distinct codes (from ``Chunk.codes``) of each document."""
    if not len(codes):
        return np.zeros(n_docs, np.int64)
    size = int(codes.max()) + 1
    return np.bincount(np.unique(docs * size + codes) // size, minlength=n_docs)


def dense(codes: np.ndarray) -> np.ndarray:
    return np.unique(codes, return_inverse=True)[1]
