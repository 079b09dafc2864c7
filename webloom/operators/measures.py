"""What text analysis counts in a text, by functions over Arrow batches: words, marks, syllables, sentences, hits of word lists, repeated runs.

A batch's words are numbered once and each distinct one is looked at once; the rest is sums by text. Word by word in the JVM the same
took a call of an interpreted function, and mostly of a regular expression, for each word and count, and rows of words were copied from step to step."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicons as lex

#: Stands between sentences; normalised texts do not hold it.
CUT = "\u0001"
#: Texts are taken in pieces of so many bytes, whatever the batch.
MOST = 4 << 20
FOR, AGAINST, TURNS = 1, 2, 4
COUNTS = [
    "tokens", "words", "characters", "long_words", "marks", "numbers", "distinct", "syllables", "hard", "syllables_ru", "hard_ru", "sentences", "long_sentences",
    "hits", "hit_sum", "rated", "positive", "negative", *lex.EMOTIONS,
]


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, number of the word) of each run of characters that are no white space, and the runs by number."""
    lists = pc.ascii_split_whitespace(texts)
    coded = pc.list_flatten(lists).dictionary_encode()
    doc, code = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    there = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[code]  # a text that begins or ends with white space gives empty ones
    return doc[there], code[there], coded.dictionary


def _lowered(words: pa.Array) -> pa.Array:
    """By the full mapping, as lower() has it: two letters lower by their place, or to two characters."""
    special = pc.match_substring_regex(words, "[İΣ]")
    return pc.replace_with_mask(pc.utf8_lower(words), special, pa.array([w.lower() for w in words.filter(special).to_pylist()], words.type))


def _mask(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False).astype(bool)


def _among(words: pa.Array, listed: list[str]) -> np.ndarray:
    return _mask(pc.is_in(words, pa.array(listed, words.type)))


def _by_size(texts: pa.Array) -> list[pa.Array]:
    at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // MOST
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def _syllables(low: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vowel groups less a final e, one for words of up to three letters, one at least; Russian ones are vowels."""
    count = lambda p: pc.count_substring_regex(low, p).to_numpy(zero_copy_only=False).astype(np.int64)
    groups = count("[aeiouy]+") - pc.ends_with(low, "e").to_numpy(zero_copy_only=False)
    return np.where(pc.utf8_length(low).to_numpy(zero_copy_only=False) <= 3, 1, np.maximum(groups, 1)), np.maximum(count("[аеёиоуыэюя]"), 1)


def _flags(words: pa.Array) -> np.ndarray:
    return np.where(_among(words, lex.POSITIVE), FOR, np.where(_among(words, lex.NEGATIVE), AGAINST, 0)) | np.where(_among(words, lex.NEGATIONS), TURNS, 0)


def _hits(group: np.ndarray, flags: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each group of words how many are in a list, and those for less those against; a negation right before turns one round."""
    before = np.zeros(len(flags), dtype=np.int64)
    before[1:] = np.where(group[1:] == group[:-1], flags[:-1], 0)
    hit = np.flatnonzero(flags & (FOR | AGAINST))
    sign = np.where(flags[hit] & FOR, 1, -1) * np.where(before[hit] & TURNS, -1, 1)
    return np.bincount(group[hit], minlength=n), np.bincount(group[hit], weights=sign, minlength=n).astype(np.int64)


def _counts(texts: pa.Array) -> dict[str, np.ndarray]:
    n = len(texts)
    doc, code, words = _numbered(texts)
    low = _lowered(words)
    per = lambda v: np.bincount(doc, weights=v[code], minlength=n).astype(np.int64)
    cut, alpha = _mask(pc.equal(words, CUT)), _mask(pc.match_substring_regex(words, r"^\p{L}+$"))
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    syllables, syllables_ru = _syllables(low)
    out = {
        "tokens": per(~cut), "words": per(alpha), "characters": per(alpha * length), "long_words": per(alpha & (length > 6)),
        "marks": per(_among(words, list(".,;:!?()[]{}\"'"))), "numbers": per(_mask(pc.match_substring_regex(words, r"^\p{Nd}+$"))),
        "syllables": per(alpha * syllables), "hard": per(alpha & (syllables >= 3)), "syllables_ru": per(alpha * syllables_ru), "hard_ru": per(alpha & (syllables_ru >= 3)),
    }
    out |= {k: per(_among(low, v)) for k, v in lex.EMOTIONS.items()}
    own = alpha[code]
    kinds = low.dictionary_encode()
    kind, n_kinds = kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(kinds.dictionary) + 1
    both = np.sort(doc[own] * n_kinds + kind[code[own]])
    out["distinct"] = np.bincount(both[np.flatnonzero(np.diff(both, prepend=-1))] // n_kinds, minlength=n)
    flags = _flags(low)
    out["hits"], out["hit_sum"] = _hits(doc[own], flags[code[own]], n)

    begins = np.ones(len(doc), dtype=bool)
    begins[1:] = (doc[1:] != doc[:-1]) | cut[code[:-1]]
    sentence, n_sentences = np.cumsum(begins) - 1, int(begins.sum())
    text_of = doc[begins]
    out["sentences"] = np.bincount(text_of, minlength=n)
    # Words of sentences are runs of letters: mostly whole tokens, but "ab1cd" holds two.
    runs = pc.ascii_split_whitespace(pc.replace_substring_regex(low, r"\P{L}+", " "))
    there = _mask(pc.not_equal(pc.list_flatten(runs), ""))
    n_runs = np.bincount(pc.list_parent_indices(runs).to_numpy(zero_copy_only=False)[there], minlength=len(words))
    first, flat = np.cumsum(n_runs) - n_runs, _flags(pc.list_flatten(runs))[there]
    raw = pc.count_substring_regex(words, r"\p{L}+").to_numpy(zero_copy_only=False)
    size = np.bincount(sentence, weights=raw[code], minlength=n_sentences).astype(np.int64)
    out["long_sentences"] = np.bincount(text_of[size > 25], minlength=n)
    each = n_runs[code]
    token = np.repeat(np.arange(len(code)), each)
    place = np.arange(len(token)) - np.repeat(np.cumsum(each) - each, each)
    hits, total = _hits(sentence[token], flat[first[code[token]] + place], n_sentences)
    compound, rated = total / (hits + 1), size >= 5
    out["rated"] = np.bincount(text_of[rated], minlength=n)
    out["positive"] = np.bincount(text_of[rated & (compound >= 0.05)], minlength=n)
    out["negative"] = np.bincount(text_of[rated & (compound <= -0.05)], minlength=n)
    return out


def counted(texts: pa.Array) -> pa.Array:
    found = [_counts(t) for t in _by_size(texts)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([f[k] for f in found]) if found else [], pa.int64()) for k in COUNTS], names=COUNTS)


def _repeated(texts: pa.Array, size: int = 3, least: int = 3) -> np.ndarray:
    """Of each text how many runs of `size` words stand there `least` times or more. Hashes tell which places may count, the words themselves decide."""
    doc, code, words = _numbered(texts)
    low = _lowered(words).dictionary_encode()
    code, n_words = low.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code], len(low.dictionary) + 1
    at = np.arange(max(len(code) - size + 1, 0))
    at = at[doc[at] == doc[at + size - 1]]
    key = doc[at].astype(np.uint64)
    for k in range(size):
        key = (key ^ code[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.sort(key)
    often = order[: len(order) - least + 1][order[: len(order) - least + 1] == order[least - 1 :]] if len(order) >= least else order[:0]
    at = at[np.isin(key, often)]
    kind = doc[at]
    for k in range(size):  # numbered anew, so that products stay small
        _, kind = np.unique(kind * n_words + code[at + k], return_inverse=True)
    _, where, n = np.unique(kind, return_index=True, return_counts=True)
    return np.bincount(doc[at[where[n >= least]]], minlength=len(texts))


def repeated(texts: pa.Array) -> pa.Array:
    found = [_repeated(t) for t in _by_size(texts)]
    return pa.array(np.concatenate(found) if found else [], pa.int64())


def _arrow(f, kind: str):
    def run(texts: pa.Array) -> pa.Array:
        return f(texts)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def text_counts(normalized: Column) -> Column:
    """A struct of COUNTS, each long. tokens are words and single marks; words hold letters only; rated sentences have five words or more."""
    marked = F.regexp_replace(normalized, r"([.!?])\s+", f"$1 {CUT} ")
    return _arrow(counted, ", ".join(f"{k} bigint" for k in COUNTS))(F.regexp_replace(marked, rf"([^\s\p{{L}}\p{{N}}_{CUT}])", " $1 "))


def repeated_trigrams(text: Column) -> Column:
    """How many runs of three words, split at white space and in lower case, stand there three times or more."""
    return _arrow(repeated, "bigint")(text)
