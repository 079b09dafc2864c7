"""Text analysis, a row a document: statistics, readability, sentiment, emotions, calls to action, UX.

`prepare` adds the columns that the others read (norm, toks, words, sents, and the counts of measures; what a query does not read is not
computed). Everything is a projection: no shuffle. Null text counts as empty; ratios with an empty denominator are 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import text as tx
from . import measures


def prepare(df: DataFrame, text_col: str = "text") -> DataFrame:
    out = df.withColumn("norm", tx.normalize(F.col(text_col)))
    out = out.withColumn("toks", tx.tokens(F.col("norm"))).withColumn("sents", tx.sentences(F.col("norm")))
    out = out.withColumns({"counts_": measures.text_counts(F.col("norm")), "repeated_": measures.repeated_trigrams(tx.text_or_empty(F.col(text_col)))})
    return out.withColumn("words", tx.alpha(F.col("toks")))


def _count(name: str) -> Column:
    return F.col("counts_")[name]


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts and averages of prepared text."""
    n, s, t = _count("words"), _count("sentences"), _count("tokens")
    df = df.withColumns({"word_count": n, "character_count": _count("characters"), "characters_with_spaces": F.length("norm").cast("long"), "sentence_count": s})
    df = df.withColumns({
        "paragraph_count": F.size(tx.paragraphs(F.col(text_col))).cast("long"),
        "avg_sentence_length": tx.ratio(n, s), "avg_word_length": tx.ratio(F.col("character_count"), n),
        "lexical_diversity": tx.ratio(_count("distinct"), n),
        "punctuation_count": _count("marks"), "number_count": _count("numbers"), "long_word_count": _count("long_words"),
    })
    return df.withColumns({"punctuation_density": tx.ratio(F.col("punctuation_count"), t), "long_word_percent": tx.ratio(F.col("long_word_count") * 100, n)})


def readability(df: DataFrame, lang_col: str = "lang") -> DataFrame:
    """Indices from words, sentences and syllables; overall: English ease, its Russian form, or 50 without words."""
    df = df.withColumns({"n_": _count("words"), "s_": F.greatest(_count("sentences"), F.lit(1)), "c_": _count("characters"), "syllable_count": _count("syllables"), "complex_words": _count("hard"), "syl_ru_": _count("syllables_ru"), "hard_ru_": _count("hard_ru")})
    asl, asw, asw_ru = tx.ratio(F.col("n_"), F.col("s_")), tx.ratio(F.col("syllable_count"), F.col("n_")), tx.ratio(F.col("syl_ru_"), F.col("n_"))
    df = df.withColumns({"asl_": asl, "asw_": asw, "asw_ru_": asw_ru})
    ease = 206.835 - 1.015 * F.col("asl_") - 84.6 * F.col("asw_")
    points = (F.col("n_") + 2 * F.col("complex_words")) / F.col("s_")
    linsear = F.when(points > 20, points / 2).otherwise((points - 2) / 2)
    hard_share = tx.ratio(F.col("complex_words") * 100, F.col("n_"))
    dale = 0.1579 * hard_share + 0.0496 * F.col("asl_") + F.when(hard_share > 5, 3.6365).otherwise(0.0)
    df = df.withColumns({
        "flesch_reading_ease": ease,
        "flesch_kincaid_grade": 0.39 * F.col("asl_") + 11.8 * F.col("asw_") - 15.59,
        "gunning_fog": 0.4 * (F.col("asl_") + tx.ratio(F.col("complex_words") * 100, F.col("n_"))),
        "smog_index": 1.043 * F.sqrt(F.col("complex_words") * 30.0 / F.col("s_")) + 3.1291,
        "automated_readability_index": 4.71 * tx.ratio(F.col("c_"), F.col("n_")) + 0.5 * F.col("asl_") - 21.43,
        "coleman_liau_index": 5.88 * tx.ratio(F.col("c_"), F.col("n_")) - 29.6 * tx.ratio(F.col("s_"), F.col("n_")) - 15.8,
        # Both over the whole text; hard words stand for those that are in no list of easy ones.
        "linsear_write": linsear, "dale_chall": dale,
        "flesch_ru": F.least(F.greatest(206.835 - 1.3 * F.col("asl_") - 60.1 * F.col("asw_ru_"), F.lit(0.0)), F.lit(100.0)),
        "fog_ru": 0.4 * (F.col("asl_") + tx.ratio(F.col("hard_ru_") * 100, F.col("n_"))),
    })
    own = F.when(F.col("n_") == 0, F.lit(50.0)).when(F.coalesce(F.col(lang_col), F.lit("")) == "ru", F.col("flesch_ru")).otherwise(F.col("flesch_reading_ease"))
    bands = [(90, "very easy"), (80, "easy"), (70, "fairly easy"), (60, "standard"), (50, "fairly difficult"), (30, "difficult")]
    level = F.coalesce(*[F.when(F.col("overall_readability") >= x, F.lit(name)) for x, name in bands], F.lit("very difficult"))
    grades = [(90, "5th grade"), (80, "6th grade"), (70, "7th grade"), (60, "8th to 9th grade"), (50, "10th to 12th grade"), (30, "college")]
    education = F.coalesce(*[F.when(F.col("overall_readability") >= x, F.lit(name)) for x, name in grades], F.lit("graduate"))
    return df.withColumn("overall_readability", own).withColumn("readability_level", level).withColumn("education_level", education).drop("n_", "s_", "c_", "syl_ru_", "hard_ru_", "asl_", "asw_", "asw_ru_")


def quality(df: DataFrame, grammar: Column | None = None) -> DataFrame:
    """0 to 100 from readability, lexical diversity and a grammar score (100 without a checker)."""
    score = 0.4 * F.col("overall_readability") + 0.3 * 100.0 * F.col("lexical_diversity") + 0.3 * (F.lit(100.0) if grammar is None else grammar)
    return df.withColumn("overall_quality", F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)))


def grammar(df: DataFrame, errors: Column | None = None) -> DataFrame:
    """grammar_errors and grammar_score: 100 less ten for each error in a hundred words; 100 where no checker found any or there is none."""
    n = F.lit(0) if errors is None else F.coalesce(errors, F.lit(0))
    score = F.greatest(F.lit(0.0), 100.0 - 10.0 * tx.ratio(n * 100, F.size("words")))
    return df.withColumns({"grammar_errors": n.cast("long"), "grammar_score": F.when(n == 0, 100.0).otherwise(score)})


def rules(df: DataFrame, found: list[tuple[str, str, int, Column]], id_col: str = "doc_id") -> DataFrame:
    """A row for each rule (code, category, priority, condition) that holds, in the order given."""
    each = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(k).alias("rule_order"), F.lit(code).alias("code"), F.lit(cat).alias("category"), F.lit(p).alias("priority"))) for k, (code, cat, p, cond) in enumerate(found)]
    return df.select(id_col, F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("r")).select(id_col, "r.*")


def basic_rules(df: DataFrame, lang_col: str = "lang", grammar_errors: Column | None = None) -> list[tuple[str, str, int, Column]]:
    """grammar_errors: how many a checker found; there is none here."""
    lexical, n = F.col("lexical_diversity"), F.col("word_count")
    hard = F.when(F.coalesce(F.col(lang_col), F.lit("")) == "ru", F.col("flesch_ru")).otherwise(F.col("flesch_reading_ease")) < 50
    return [
        ("long_sentences", "readability", 2, F.col("avg_sentence_length") > 25), ("low_readability", "readability", 1, hard & (n > 0)),
        ("low_diversity", "vocabulary", 3, lexical < 0.4), ("high_diversity", "vocabulary", 4, (lexical > 0.8) & (n > 300)),
        ("grammar_errors", "grammar", 1, (F.lit(0) if grammar_errors is None else grammar_errors) > 5), ("long_paragraphs", "structure", 3, tx.ratio(F.col("sentence_count"), F.col("paragraph_count")) > 7),
    ]


def label_of(compound: Column) -> Column:
    return F.when(compound >= 0.05, "positive").when(compound <= -0.05, "negative").otherwise("neutral")


def sentiment(df: DataFrame) -> DataFrame:
    """Of the text and, as shares, of its sentences of five words or more (all neutral if there are none)."""
    # (hits for - hits against) / (hits + 1), -1 to 1; a negation right before turns a hit round.
    df = df.withColumn("compound", _count("hit_sum").cast("double") / (_count("hits") + 1)).withColumn("sentiment", label_of(F.col("compound")))
    n, neutral = _count("rated"), _count("rated") - _count("positive") - _count("negative")
    return df.withColumns({"positive_share": tx.ratio(_count("positive"), n), "negative_share": tx.ratio(_count("negative"), n), "neutral_share": F.when(n == 0, F.lit(1.0)).otherwise(tx.ratio(neutral, n))})


def _among(words, listed: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*listed)))


def _holding(texts, listed: list[str]) -> Column:
    """How many pairs of a text and a listed string it contains."""
    return F.aggregate(texts, F.lit(0), lambda a, c: a + sum((c.contains(w).cast("int") for w in listed[1:]), c.contains(listed[0]).cast("int")))


def emotions(df: DataFrame) -> DataFrame:
    """Hits of each emotion, the dominant one (the first of the greatest; joy without hits) and hits a token."""
    df = df.withColumns({k: _count(k) for k in lex.EMOTIONS})
    names = list(lex.EMOTIONS)
    top = F.greatest(*names)
    first = reduce(lambda acc, k: F.when(F.col(k) == top, F.lit(k)).otherwise(acc), reversed(names), F.lit("joy"))
    return df.withColumns({"dominant_emotion": first, "emotional_intensity": tx.ratio(sum((F.col(k) for k in names[1:]), F.col(names[0])), _count("tokens"))})


def emotion_profile(df: DataFrame) -> DataFrame:
    """Of each emotion its share of all hits, and the sentences that hold one of its words anywhere in them."""
    df = emotions(df)
    total = sum((F.col(k) for k in list(lex.EMOTIONS)[1:]), F.col(next(iter(lex.EMOTIONS))))
    held = lambda words: F.filter("sents", lambda s: reduce(lambda a, b: a | b, [F.contains(F.lower(s), F.lit(w)) for w in words]))
    return df.withColumns({f"{k}_share": tx.ratio(F.col(k), total) for k in lex.EMOTIONS} | {f"{k}_sentences": held(v) for k, v in lex.EMOTIONS.items()})


def action_contexts(df: DataFrame, text_col: str = "text", around: int = 50) -> DataFrame:
    """With the calls to action of each pattern in order, and the text around each; needs `ctas` of calls_to_action."""
    text = tx.text_or_empty(F.col(text_col))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("last"), F.array().cast("array<string>").alias("out"))

    def step(a, c):
        # The matches of one pattern ascend; a new pattern starts anew where nothing follows.
        after = F.call_function("locate", c, F.lower(text), a["at"] + 1)
        at = F.when(after > 0, after).otherwise(F.call_function("locate", c, F.lower(text), F.lit(1)))
        begin = F.greatest(at - around, F.lit(1))
        return F.struct(at.alias("at"), c.alias("last"), F.concat(a["out"], F.array(F.substring(text, begin, at - begin + F.length(c) + around))).alias("out"))

    return df.withColumn("cta_contexts", F.aggregate("ctas", start, step)["out"])


def calls_to_action(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All matches of the patterns, the trigger classes they hold, and their effectiveness (0 to 100)."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.lower(tx.text_or_empty(F.col(text_col))), F.lit(p), F.lit(0)) for p in lex.CTA_PATTERNS]))
    df = df.withColumn("ctas", found)
    per = [_holding("ctas", v) for v in lex.CTA_TRIGGERS.values()]
    df = df.withColumn("hits_", F.array(*per))
    classes, hits = F.size(F.filter("hits_", lambda x: x > 0)), F.aggregate("hits_", F.lit(0), lambda a, x: a + x)
    names = F.filter(F.transform(F.arrays_zip(F.array(*[F.lit(k) for k in lex.CTA_TRIGGERS]).alias("name"), F.col("hits_").alias("n")), lambda x: F.when(x["n"] > 0, x["name"])), lambda x: x.isNotNull())
    score = 100.0 * (0.6 * classes / 6.0 + 0.4 * F.least(F.lit(1.0), tx.ratio(hits, 2 * F.size("ctas"))))
    return df.withColumns({"cta_count": F.size("ctas").cast("long"), "cta_triggers": names, "cta_effectiveness": F.when(F.size("ctas") > 0, score).otherwise(0.0)}).drop("hits_")


def _penalty(value: Column, *steps: tuple[float, float]) -> Column:
    return F.coalesce(*[F.when(value > x, F.lit(float(y))) for x, y in steps], F.lit(0.0))


def user_experience(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Clarity, distractions, fit for an audience, and their mix."""
    text = tx.text_or_empty(F.col(text_col))
    df = df.withColumns({"asl_": tx.ratio(_count("words"), _count("sentences")), "hard_": tx.ratio(_count("long_words") * 100, _count("words")), "long_sentences": _count("long_sentences")})
    clarity = 100.0 - _penalty(F.col("asl_"), (25, 30), (20, 20), (15, 10)) - _penalty(F.col("hard_"), (30, 30), (20, 20), (10, 10))
    caps = F.regexp_count(text, F.lit(r"(?=[A-Z])(?<![\p{L}\p{N}_])[A-Z]{2,}+(?![\p{L}\p{N}_])"))
    df = df.withColumns({
        "clarity": clarity, "caps": caps.cast("long"), "exclamations": F.regexp_count(text, F.lit("!")).cast("long"),
        "ellipses": F.regexp_count(text, F.lit(r"\.\.\.")).cast("long"), "repeated_trigrams": F.col("repeated_"),
    })
    kinds = (F.col("caps") > 3).cast("int") + (F.col("exclamations") > 5).cast("int") + (F.col("ellipses") > 5).cast("int") + (F.col("repeated_trigrams") > 0).cast("int")
    word, sentence = tx.ratio(_count("characters"), _count("tokens")), tx.ratio(_count("tokens"), _count("sentences"))
    fit = 70.0 + F.when(word > 6, -20.0).when(word < 4, 10.0).otherwise(0.0) + F.when(sentence > 20, -20.0).when(sentence < 10, 10.0).otherwise(0.0)
    df = df.withColumns({"distraction_level": F.least(F.lit(100.0), 20.0 * kinds), "audience_fit": F.least(F.greatest(fit, F.lit(0.0)), F.lit(100.0))})
    return df.withColumn("ux_score", 0.4 * F.col("clarity") + 0.3 * (100.0 - F.col("distraction_level")) + 0.3 * F.col("audience_fit")).drop("asl_", "hard_")


def experience_rules() -> list[tuple[str, str, int, Column]]:
    return [
        ("negative_tone", "sentiment", 2, F.col("sentiment") == "negative"), ("too_neutral", "sentiment", 4, F.col("neutral_share") > 0.8),
        ("low_emotion", "emotion", 4, F.col("emotional_intensity") < 0.05), ("no_cta", "cta", 2, F.col("cta_count") == 0),
        ("weak_cta", "cta", 3, (F.col("cta_count") > 0) & (F.col("cta_effectiveness") < 40)), ("unclear", "ux", 2, F.col("clarity") < 60),
        ("distracting", "ux", 3, F.col("distraction_level") > 40), ("poor_fit", "ux", 3, F.col("audience_fit") < 60),
    ]


def language(df: DataFrame, text_col: str = "text", default: str = "en") -> DataFrame:
    """By marks of the writing: Cyrillic is ru; else the language with most stop words of its own; default if none or under ten characters."""
    words = F.regexp_extract_all(F.lower(tx.text_or_empty(F.col(text_col))), F.lit(r"\p{L}+"), F.lit(0))
    common = {k: v for k, v in lex.STOPWORDS_BY_LANGUAGE.items() if k != "ru"}
    df = df.withColumn("w_", words)
    hits = [F.struct(_among("w_", v).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, v) in enumerate(common.items())]
    best = F.array_max(F.array(*hits))
    cyrillic = F.regexp_count(tx.text_or_empty(F.col(text_col)), F.lit(r"[Ѐ-ӿ]"))
    found = F.when(F.length(F.trim(tx.text_or_empty(F.col(text_col)))) < 10, F.lit(default)).when(cyrillic * 2 > F.length(tx.text_or_empty(F.col(text_col))), F.lit("ru")).when(best["n"] > 0, best["name"]).otherwise(F.lit(default))
    return df.withColumn("detected_lang", found).drop("w_")


def coherence(df: DataFrame) -> DataFrame:
    """Mean Jaccard similarity of neighbouring sentences' word sets; 1 for fewer than two sentences."""
    df = df.withColumn("sets_", F.transform("sents", lambda s: F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"\p{L}+"), F.lit(0)))))
    ahead = F.slice("sets_", F.lit(2), F.greatest(F.size("sets_"), F.lit(1)))
    each = F.slice(F.zip_with("sets_", ahead, lambda a, b: F.coalesce(tx.ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))), F.lit(1), F.greatest(F.size("sets_") - 1, F.lit(0)))
    mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("sets_") - 1, F.lit(1))
    return df.withColumn("coherence", F.when(F.size("sets_") < 2, F.lit(1.0)).otherwise(mean)).drop("sets_")
