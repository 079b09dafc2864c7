"""Words and word n-grams of whole Arrow batches as 64-bit hashes, without a Python step for each word.

A word is a run of bytes other than space and U+0009 to U+000D. Its hash is a polynomial of its bytes, each
mapped to a random 64-bit number (A-Z as a-z where folded), cut out of a running sum over the batch and
mixed; an n-gram's hash mixes those of its words in order."""

from __future__ import annotations

import numpy as np

from .common import release

_RNG = np.random.default_rng(20240607)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _FOLDED[97:123]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection on 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, (1 << 19) + 1)
        _POWERS[:] = [np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(size - 1, b, dtype=np.uint64))]) for b in (_BASE, _INVERSE)]
    return _POWERS


class Words:
    """The words of several documents: hash, start and end (byte places within `data`), doc (index)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True):
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        n = len(data)
        inside = _IS_WORD[data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True  # a document's first byte never goes on a word of the one before
        start = inside.copy()
        start[1:] &= ~inside[:-1] | first[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | first[1:n]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        up, down = _powers(n + 1)
        run = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_FOLDED if fold else _BYTES)[data] * up[:n], out=run[1:])
        self.hash = mix((run[self.end] - run[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))  # of each document's words

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the first word) of each k-gram that lies within a document."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        h = self.hash[:n] * _PLACES[0]
        for j in range(1, k):
            h = h + self.hash[j : j + n] * _PLACES[j]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 : k - 1 + n])
        return mix(h[at]), at

    def shingle_sets(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, doc) of each document's distinct k-grams, ascending within the document; a document of
        fewer words has its whole sequence as one."""
        h, at = self.grams(k)
        doc = self.doc[at]
        count = np.diff(self.first)
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            whole = np.array([int((self.hash[self.first[d] : self.first[d + 1]] * _PLACES[: count[d]]).sum(dtype=np.uint64)) + int(count[d]) * 7 & 0xFFFFFFFFFFFFFFFF for d in few], dtype=np.uint64)
            h, doc = np.concatenate([h, mix(whole ^ np.uint64(0xA5A5A5A5))]), np.concatenate([doc, few])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return h[new], doc[new]


def word_slices(texts, most_bytes: int = 1 << 19, fold: bool = True):
    """(first document, Words) over consecutive slices of an Arrow string array; null counts as empty."""
    texts = texts.combine_chunks() if hasattr(texts, "combine_chunks") else texts
    width = np.int64 if str(texts.type) in ("large_string", "large_binary") else np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, width, len(texts) + 1, texts.offset * width().itemsize).astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most_bytes, side="right")) - 1)
        yield a, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], fold)
        a = b
    release()
