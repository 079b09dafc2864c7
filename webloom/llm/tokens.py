"""Token ids of texts, by a byte-level BPE of the tokenizers library.

The vocabulary's pattern never lets a piece hold a space except as its first character. So a text may be
cut before every single space that has no white space beside it, and the ids of the parts, joined, are
those of the text; likewise before every single line end. Each distinct part is merged once by the
library's BPE model, plain words many in a run, and then taken from a bounded table of its worker, keyed by its
64-bit hash; the ids of a batch are gathered from the table's by array operations. Texts in which white space adjoins a space, and parts that hold a special
token's string or letters beyond the Cyrillic block, go through the library's whole chain.
tests/llm compares both ways.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import regex

from .wordhash import Words

END_ID = 2
#: The vocabulary's fixed pattern.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Bytes that are no visible Latin-1 characters stand for code points from 256 on, in order.
VISIBLE = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
BESIDE = re.compile(r" \s|\s ")
MARKS = frozenset(",.;:!?")
_CODES = np.array([VISIBLE.get(b, b) for b in range(256)], dtype="<u2")
#: Parts whose words and marks the vocabulary's merges never join across, even without its pattern.
PLAIN_MARKS = r"""!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~"""
SAFE = re.compile(f"\n?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+[{PLAIN_MARKS}]{{0,4}}")
LETTER_BYTES = "A-Za-z" + "".join(chr(VISIBLE.get(b, b)) for b in (*range(0x80, 0xC0), *range(0xC3, 0xCA)))
ODD = "".join(c for c in map(chr, range(0x10000)) if c.isspace() and c not in " \n")
RUN = 256
#: First bytes of white space that a text may hold besides spaces and line ends.
UNSURE = np.zeros(256, dtype=bool)
UNSURE[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
MOST_PARTS, MOST_IDS = 700_000, 1 << 22


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending distinct values, where one of each stands, which of them each is)."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(x), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


class Table:
    """Ids by hash, in sorted arrays: some 25 bytes an entry. New entries gather in a small part of their own."""

    def __init__(self):
        none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.old, self.recent, self.pool, self.used = none, none, np.empty(1 << 16, dtype="<u4"), 0

    def full(self) -> bool:
        return len(self.old[0]) + len(self.recent[0]) > MOST_PARTS or self.used > MOST_IDS

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the ids begin in the pool, or -1; how many they are) of ascending keys."""
        at, size = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        for known, begin, n in (self.old, self.recent):
            if len(known):
                p = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[p] == keys
                at[hit], size[hit] = begin[p[hit]], n[p[hit]]
        return at, size

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        if self.used + len(ids) > len(self.pool):
            pool = np.empty(max(2 * len(self.pool), self.used + len(ids)), dtype="<u4")
            pool[: self.used] = self.pool[: self.used]
            self.pool = pool
        self.pool[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(size) - size
        self.used += len(ids)
        self.recent = self._merged(self.recent, (keys, begin, size.astype(np.int32)))
        if len(self.recent[0]) * 8 > len(self.old[0]):
            self.old, self.recent = self._merged(self.old, self.recent), tuple(x[:0] for x in self.recent)
        return begin

    @staticmethod
    def _merged(a, b):
        at = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, at, y) for x, y in zip(a, b))


class Encoder:
    """Ids as little-endian unsigned 32-bit integers in bytes objects."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.table = Table()

        model = self.tokenizer.model
        self.merge = lambda piece: array("I", [t.id for t in model.tokenize(piece)]).tobytes()
        self.short: dict[str, bytes] = {}
        self.bare = Tokenizer(model)  # without the library's pattern
        names = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        mixed = re.compile(f"[{LETTER_BYTES}][{PLAIN_MARKS}\u0120\u010a]|[{PLAIN_MARKS}][{LETTER_BYTES}\u0120\u010a]")
        only = re.compile(f"[{LETTER_BYTES}{PLAIN_MARKS}\u0120\u010a]+")
        self.opens = None
        if not any(mixed.search(t) and only.fullmatch(t) for t, _ in names):
            self.opens = np.zeros(names[-1][1] + 1, dtype=bool)
            self.opens[[i for t, i in names if t[0] in "\u0120\u010a"]] = True

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, space: str, word: str) -> bytes:
        """Of a word of letters with or without its space."""
        return self.merge(space + (word if word.isascii() else visible(word)))

    def _part(self, part: str) -> bytes:
        if not part:
            return b""
        if max(part) >= "\u0530" or "<|" in part:
            return self._whole(part)
        space, body = ("\u0120", part[1:]) if part[0] == " " else ("", part)
        if body.isalpha():
            return self._word(space, body)
        if body[-1:] in MARKS and body[:-1].isalpha():
            return self._word(space, body[:-1]) + self._piece(body[-1])
        if "\n" in body:
            first, _, rest = body.partition("\n")
            if first and rest and not first[-1].isspace() and not rest[0].isspace():
                return self._part(part[: len(part) - len(rest) - 1]) + self._piece("\n") + self._part(rest)
        return b"".join(map(self._piece, PIECES.findall(part)))

    def _piece(self, piece: str) -> bytes:
        got = self.short.get(piece)
        if got is None:
            got = self.merge(visible(piece))
            if len(piece) <= 3 and len(self.short) < 100_000:
                self.short[piece] = got
        return got

    def _safe(self, parts: list[str]) -> list[bytes]:
        """Of parts that SAFE matches: many are merged in one run, and cut where a token opens with its space or line end."""
        runs = ["".join([p if p[0] == "\n" else " " + p for p in parts[k : k + RUN]]) for k in range(0, len(parts), RUN)]
        runs = [visible(r) for r in runs]
        ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in self.bare.encode_batch_fast(runs, add_special_tokens=False)])
        ends = [*(np.flatnonzero(self.opens[ids]) * 4).tolist(), len(ids) * 4]
        if len(ends) != len(parts) + 1:
            raise ValueError("the vocabulary merges beyond words")
        ids = ids.tobytes()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def _strings(self, parts: list[str]) -> list[bytes]:
        """Of parts with their space or line end; a part that opens a text has neither."""
        plain = [p[p[0] == " " :] for p in parts]
        safe = [k for k, p in enumerate(parts) if p[0] in " \n" and SAFE.fullmatch(plain[k])] if self.opens is not None else []
        out: list[bytes | None] = [None] * len(parts)
        for k, got in zip(safe, self._safe([plain[k] for k in safe]) if safe else ()):
            out[k] = got
        return [self._part(p) if o is None else o for o, p in zip(out, parts)]

    def _slow(self, text: str) -> bytes:
        if not single_spaced(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        return b"".join([self._part(first), *(self._part(" " + p) for p in rest)])

    def encode(self, words: Words, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the documents in turn, where each document ends); end_id is appended to each."""
        data, doc, n = words.data, words.doc, words.n_docs
        gap = words.start.copy()  # what stands before a word: 0 nothing, 1 a space, 2 a line end, 9 anything else
        gap[1:] -= words.end[:-1]
        opens = np.zeros(len(doc), dtype=bool)
        opens[words.first[:-1][np.diff(words.first) > 0]] = True
        sep = np.where(gap == 1, np.array([9, 1, 2], dtype=np.uint64)[(data[words.start - 1] == 32) + 2 * (data[words.start - 1] == 10)] if len(data) else 9, 9).astype(np.uint64)
        sep[opens] = np.where(words.start[opens] == words.offsets[doc[opens]], 0, 9)
        slow = np.zeros(n, dtype=bool)
        slow[doc[sep == 9]] = True
        length, has = np.diff(words.offsets), np.diff(words.first) > 0
        slow[~has & (length > 0)] = True
        slow[has] |= words.end[words.first[1:][has] - 1] != words.offsets[1:][has]
        for d in np.unique(np.searchsorted(words.offsets, np.flatnonzero(UNSURE[data]), side="right") - 1).tolist():
            slow[d] = slow[d] or not single_spaced(self._text(words, d))

        fast = np.flatnonzero(~slow[doc])
        keys, first, inverse = distinct(words.hash[fast] + sep[fast] * np.uint64(0x9E3779B97F4A7C15))
        if self.table.full():
            self.table = Table()
        origin, size = self.table.find(keys)
        new = np.flatnonzero(origin < 0)
        if len(new):
            raw, at = data.tobytes(), fast[first[new]]
            begins = (words.start[at] - (sep[at] > 0)).tolist()
            got = self._strings([raw[a:b].decode() for a, b in zip(begins, words.end[at].tolist())])
            size[new] = np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // 4
            origin[new] = self.table.add(keys[new], np.frombuffer(b"".join(got), "<u4"), size[new])
        pool = self.table.pool

        per_word = size[inverse]
        count = np.bincount(doc[fast], weights=per_word, minlength=n).astype(np.int64)
        whole = {d: np.frombuffer(self._slow(self._text(words, d)), "<u4") for d in np.flatnonzero(slow).tolist()}
        for d, ids in whole.items():
            count[d] = len(ids)
        ends = np.cumsum(count + (end_id is not None))
        out = np.empty(int(ends[-1]) if n else 0, dtype="<u4")
        if end_id is not None:
            out[ends - 1] = end_id
        begin = np.cumsum(per_word) - per_word  # of each word's ids among the fast ones
        from_ = np.arange(int(per_word.sum())) + np.repeat(origin[inverse] - begin, per_word)
        doc_begin = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(np.where(slow, 0, count), out=doc_begin[1:])
        to = np.arange(len(from_)) + np.repeat((ends - count - (end_id is not None))[~slow] - doc_begin[:-1][~slow], count[~slow])
        out[to] = pool[from_]
        for d, ids in whole.items():
            out[ends[d] - len(ids) - (end_id is not None) : ends[d] - (end_id is not None)] = ids
        return out, ends

    @staticmethod
    def _text(words: Words, d: int) -> str:
        return words.data[words.offsets[d] : words.offsets[d + 1]].tobytes().decode()


def visible(text: str) -> str:
    """The text's bytes as the vocabulary writes them."""
    return _CODES[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")


def single_spaced(text: str) -> bool:
    """Whether no white space stands beside a space."""
    if "  " in text or " \n" in text or "\n " in text:
        return False
    odd = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f" if text.isascii() else ODD
    return not any(c in text for c in odd) or not BESIDE.search(text)


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder; its table of parts outlives the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
