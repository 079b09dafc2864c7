"""Column functions over text: normalisation, tokens, sentences, syllables, n-grams. All run in the JVM.

Null text counts as empty everywhere; empty text has no tokens and no sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
ALPHA = r"^\p{L}+$"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def squeeze(text: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text_or_empty(text), r"[^\S ]\s*| \s+", " "))  # single spaces stay as they are


def normalize(text: Column) -> Column:
    """White space squeezed, tags and unusual characters to spaces."""
    out = F.regexp_replace(squeeze(text), r"<[^>]+>", " ")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}_\s.,!?;:'\"()\[\]{}«»–—-]", " ")
    return squeeze(out)


def tokens(normalized: Column) -> Column:
    """Words and single marks, in order."""
    return F.regexp_extract_all(normalized, F.lit(TOKEN), F.lit(0))


def alpha(toks: Column) -> Column:
    """The tokens that are letters only."""
    return F.filter(toks, lambda t: t.rlike(ALPHA))


def lower(toks: Column) -> Column:
    return F.transform(toks, lambda t: F.lower(t))


def sentences(normalized: Column) -> Column:
    """Cut after . ! ? and white space."""
    cut = F.split(F.regexp_replace(normalized, r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.filter(cut, lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text_or_empty(text), r"\n\s*\n"), lambda p: p.rlike(r"\S"))


def syllables(word: Column) -> Column:
    """Vowel groups less a final e, one for words of up to three letters, one at least."""
    w = F.lower(word)
    groups = F.regexp_count(w, F.lit(r"[aeiouy]+")) - F.when(w.endswith("e"), 1).otherwise(0)
    return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(groups, F.lit(1))).cast("int")


def syllables_ru(word: Column) -> Column:
    return F.greatest(F.regexp_count(F.lower(word), F.lit("[аеёиоуыэюя]")), F.lit(1)).cast("int")


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces. Built by zipping, so nothing is computed more than once a word."""
    out = words
    for k in range(1, n):
        out = F.zip_with(out, F.slice(words, F.lit(k + 1), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.slice(out, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))


def total_length(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))
