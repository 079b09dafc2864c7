"""Languages of texts by profiles of character trigrams.

A profile is a language's most frequent trigrams of letters and single spaces between words, learned from texts whose language is known. A text
goes to the language under which its trigrams are likeliest; trigrams of no profile say nothing. Whole texts are never taken apart into rows: maps over Arrow batches
count the trigrams of each language, and sum the logarithms of a text's trigrams. Profiles are bounded by their length, so they are sent to each task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

#: Trigrams of a profile, what an unseen one counts, characters that a text must have.
LENGTH, UNSEEN, LEAST = 2000, 0.5, 10


def held_out(key: Column) -> Column:
    """A fourth of the keys, by hash: their languages are not learned from."""
    return F.substring(F.md5(key.cast("string").cast("binary")), 1, 1).isin("0", "1", "2", "3")


def _letters(text: Column) -> Column:
    """The text's letters in lower case with a space around each run of them; empty for none."""
    return F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), F.lower(tx.text_or_empty(text)), F.lit(" ")), r"[^\p{L}]+", " "), "^ $", "")


def trigrams(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """(keep.., gram, n): how often each trigram stands in each text."""
    s = _letters(F.col(text_col))
    # Characters are cut once; a substring at each place would scan the text again and again.
    after = lambda k: F.slice("lg_c_", F.lit(k), F.greatest(F.size("lg_c_"), F.lit(1)))
    runs = F.zip_with(F.zip_with(F.col("lg_c_"), after(2), lambda a, b: F.concat(a, b)), after(3), lambda a, b: F.concat(a, b))
    rows = df.select(*keep, F.split(s, "").alias("lg_c_")).select(*keep, F.explode(runs).alias("gram")).where(F.length("gram") == 3)
    return rows.groupBy(*keep, "gram").agg(F.count(F.lit(1)).alias("n"))


def profiles(grams: DataFrame, lang_col: str = "lang", length: int = LENGTH) -> DataFrame:
    """(gram, weights) from (lang, gram, n): the logarithm of its likelihood under each language, as a map's entries by language. Null languages are left out."""
    counts = grams.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("found"), "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("found").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= length)
    total = top.groupBy("found").agg(F.sum("n").alias("total"))  # a row a language
    size = F.broadcast(top.agg(F.count_distinct("gram").alias("size")))
    each = top.select("gram").distinct().crossJoin(F.broadcast(total)).crossJoin(size).join(top.select("found", "gram", "n"), ["found", "gram"], "left")
    weight = F.log((F.coalesce("n", F.lit(0)) + UNSEEN) / (F.col("total") + UNSEEN * F.col("size")))
    return each.select("gram", "found", weight.alias("w"))


def likeliest(grams: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, found): the language of largest likelihood, of equals the first by name; texts without a known trigram have none."""
    sums = grams.select(key, "gram", "n").join(F.broadcast(known), "gram").groupBy(key, "found").agg(F.round(F.sum(F.col("n") * F.col("w")), 6).alias("likelihood"))
    return sums.groupBy(key).agg(F.min_by("found", F.struct((-F.col("likelihood")).alias("l"), "found")).alias("found"))


def _numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the trigram, text) at each place where one stands; a code point takes 21 bits."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    text = np.repeat(np.arange(len(texts)), size)
    if len(code) < 3:
        return code[:0], text[:0]
    whole = text[2:] == text[:-2]
    return ((code[:-2] << 42) | (code[1:-1] << 21) | code[2:])[whole], text[2:][whole]


def _number(gram: str) -> int:
    return (ord(gram[0]) << 42) | (ord(gram[1]) << 21) | ord(gram[2])


def _gram(number: int) -> str:
    return "".join(chr((number >> k) & ((1 << 21) - 1)) for k in (42, 21, 0))


def _by_language(batches):
    """(lang, letters) -> (lang, gram, n), summed over a batch."""
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        lang = coded.indices.to_numpy()
        number, text = _numbered(batch.column(1).to_pylist())
        for k, name in enumerate(coded.dictionary.to_pylist()):
            grams, n = np.unique(number[lang[text] == k], return_counts=True)
            yield pa.record_batch([pa.array([name] * len(grams), pa.string()), pa.array([_gram(g) for g in grams.tolist()], pa.string()), pa.array(n)], names=["lang", "gram", "n"])


def _likelihoods(numbers: np.ndarray, weights: np.ndarray):
    """(id, letters) -> (id, likelihoods): the sum of the weights of a text's trigrams under each language; none where no trigram is known."""

    def run(batches):
        for batch in batches:
            number, text = _numbered(batch.column(1).to_pylist())
            at = np.minimum(np.searchsorted(numbers, number), len(numbers) - 1)
            known = numbers[at] == number
            at, text = at[known], text[known]
            sums = np.stack([np.bincount(text, weights=w[at], minlength=batch.num_rows) for w in weights], axis=1)
            some = np.flatnonzero(np.bincount(text, minlength=batch.num_rows))
            yield pa.record_batch([batch.column(0).take(pa.array(some)), pa.array(list(sums[some]), pa.list_(pa.float64()))], names=["key", "likelihoods"])

    return run


def _best(df: DataFrame, known: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, found) as of `likeliest`, from the texts themselves."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = known.toArrow().to_pylist()  # bounded by the profiles' length
    names, grams = sorted({r["found"] for r in rows}, key=lambda x: x.encode()), sorted({r["gram"] for r in rows}, key=_number)
    if not rows:
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, found string")
    place = {g: n for n, g in enumerate(grams)}
    weights = np.zeros((len(names), len(grams)))
    for r in rows:
        weights[names.index(r["found"]), place[r["gram"]]] = r["w"]
    each = df.select(F.col(id_col).alias("key"), _letters(F.col(text_col)).alias("s")).mapInArrow(_likelihoods(np.array([_number(g) for g in grams]), weights), f"key {kind}, likelihoods array<double>")
    sums = each.groupBy(F.col("key").alias(id_col)).agg(*[F.round(F.sum(F.col("likelihoods")[k]), 6).alias(f"lg_{k}") for k in range(len(names))])
    least = F.array_min(F.array(*[F.struct((-F.col(f"lg_{k}")).alias("l"), F.lit(k).alias("k")) for k in range(len(names))]))
    return sums.select(id_col, F.element_at(F.array(*[F.lit(n) for n in names]), least["k"] + 1).alias("found"))


def detected(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", default: str = "en", length: int = LENGTH) -> DataFrame:
    """df with held_out and detected_lang. The default stands for texts of under ten characters and those without known trigrams; texts that are mostly
    Cyrillic are ru, with or without a profile."""
    df = df.withColumn("held_out", held_out(F.col(id_col)))
    learned = df.where(~F.col("held_out") & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), _letters(F.col(text_col)).alias("s"))
    best = _best(df, profiles(learned.mapInArrow(_by_language, "lang string, gram string, n bigint"), "lang", length), text_col, id_col)
    raw = F.trim(tx.text_or_empty(F.col(text_col)))
    # Told before the join, so that texts do not have to be exchanged for it.
    sure = F.when(F.length(raw) < LEAST, default).when(F.regexp_count(raw, F.lit("[Ѐ-ӿ]")) * 2 > F.length(raw), "ru")
    return df.withColumn("lg_sure", sure).join(best, id_col, "left").withColumn("detected_lang", F.coalesce("lg_sure", "found", F.lit(default))).drop("found", "lg_sure")
