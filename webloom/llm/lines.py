"""Line-first quality rules.

Every line with a word is judged by itself, the failing lines are removed, and a document is rejected if
it lost too much of its text. A line fails if it

  * is navigation: three or more separators (| > and their typographic kin), at least one to five words;
  * is badly punctuated: it has five words or more and no sentence mark at all, or doubled exclamation
    or question marks after a fifth of its words or more, or symbols (# * $ % &) on a third of them;
  * is boilerplate: a fourth of its words or more are one of the stock phrases below;
  * repeats an earlier line of the document.

Beside that verdict the base statistics of the contract are computed and its two base rules applied.

Defined results: null and empty texts have no words, fail the base rule and are not kept; line ends are
\\n alone; repeated rows are judged alike; an empty table gives an empty result. Extra columns pass
through, but for those of the output's names (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_share,
clean_text, kept, in any case), which are replaced; names that start with `_ln_` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, read, words

#: Fixed phrases of page furniture in English, German, French and Spanish, in lower case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "cookie settings", "enable javascript", "javascript is disabled",
    "log in to comment", "lorem ipsum", "powered by wordpress", "privacy policy", "read more", "share this", "sign up for", "skip to content", "subscribe to",
    "terms of service", "terms of use", "we use cookies",
    "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "cookies akzeptieren", "datenschutzerklärung", "hier klicken", "jetzt anmelden",
    "mehr lesen", "nach oben", "newsletter abonnieren", "wir verwenden cookies", "zum inhalt springen",
    "accepter les cookies", "aller au contenu", "cliquez ici", "conditions d'utilisation", "haut de page", "lire la suite", "mentions légales",
    "nous utilisons des cookies", "politique de confidentialité", "tous droits réservés",
    "aceptar cookies", "aviso legal", "haga clic aquí", "ir al contenido", "leer más", "política de privacidad", "términos de uso",
    "todos los derechos reservados", "utilizamos cookies", "volver arriba",
)
#: A phrase makes a line boilerplate only if at least one in so many of its words is the phrase's.
PHRASE_SHARE = 4
NAVIGATION = r"[|>»›•]"
SENTENCE = r"[.!?…。؟।:;]"
SHOUT = r"[!?]{2,}"
SYMBOL = r"[#*$%&]"
MIN_KEPT = 0.5
MIN_WORDS = 50


def phrases() -> list[tuple[int, str]]:
    """(words, pattern) for the phrases of each number of words; letters on neither side."""
    of = {n: [p for p in BOILERPLATE if len(p.split()) == n] for n in sorted({len(p.split()) for p in BOILERPLATE})}
    return [(n, rf"(^|[^\p{{L}}])({'|'.join(own)})([^\p{{L}}]|$)") for n, own in of.items()]


def line_passes(line: Column) -> Column:
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    navigation, shout, symbols = (F.regexp_count(line, F.lit(p)) for p in (NAVIGATION, SHOUT, r"[#*$%&]+"))
    fails = (
        (navigation >= 3) & (navigation * 5 >= n)
        | (n >= 5) & ~line.rlike(SENTENCE)
        | (shout >= 1) & (shout * 5 >= n)
        | (symbols >= 1) & (symbols * 3 >= n)
    )
    # The plain phrases are looked for once; what they find is rare.
    found = F.lit(False)
    for words_of, pattern in phrases():
        found = found | (n <= PHRASE_SHARE * words_of) & F.lower(line).rlike(pattern)
    longest = PHRASE_SHARE * max(words_of for words_of, _ in phrases())
    return ~(fails | F.when((n <= longest) & F.lower(line).rlike("|".join(BOILERPLATE)), found).otherwise(False))


def repeat_words(df: DataFrame, col: str, out: str) -> DataFrame:
    """Adds how many words of the array `col` stand in 3-word windows that occur twice or more.

    The windows are sorted with their places, so that equal ones are neighbours; only documents in which
    the windows are not all different get that far. All work is n log n within the row."""
    three = F.zip_with(F.zip_with(col, F.slice(col, F.lit(2), F.greatest(F.size(col), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), F.slice(col, F.lit(3), F.greatest(F.size(col), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    df = df.withColumn("_ln_g", F.slice(three, F.lit(1), F.greatest(F.size(col) - 2, F.lit(0))))
    df = df.withColumn("_ln_g", F.when(F.size(F.array_distinct("_ln_g")) < F.size("_ln_g"), F.col("_ln_g")).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_ln_g", F.sort_array(F.transform("_ln_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    before = F.concat(F.array(F.lit(None).cast("struct<g:string,i:int>")), F.slice("_ln_g", F.lit(1), F.greatest(F.size("_ln_g") - 1, F.lit(0))))
    df = df.withColumn("_ln_g", F.slice(F.zip_with("_ln_g", before, lambda x, y: F.struct(x["i"].alias("i"), F.coalesce(x["g"] == y["g"], F.lit(False)).alias("p"))), F.lit(1), F.size("_ln_g")))
    both = F.zip_with("_ln_g", F.slice("_ln_g", F.lit(2), F.greatest(F.size("_ln_g"), F.lit(1))), lambda x, y: F.when(x["p"] | F.coalesce(y["p"], F.lit(False)), x["i"]))
    df = df.withColumn("_ln_g", F.sort_array(F.filter(both, lambda i: i.isNotNull())))
    before = F.concat(F.array(F.lit(-3)), F.slice("_ln_g", F.lit(1), F.greatest(F.size("_ln_g") - 1, F.lit(0))))
    steps = F.zip_with("_ln_g", before, lambda x, y: F.coalesce(F.least(F.lit(3), x - y), F.lit(0)))
    covered = F.aggregate(steps, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return df.withColumn(out, F.when(F.size("_ln_g") > 0, covered).otherwise(F.lit(0)).cast("long")).drop("_ln_g")


def judge_lines(df: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, min_kept: float = MIN_KEPT) -> DataFrame:
    """df with the base statistics, base_failed, kept_share, clean_text and kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn("_ln_w", words(F.col(text_col))).withColumn("_ln_l", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_ln_d", F.array_distinct("_ln_l")).withColumn("_ln_p", F.filter("_ln_d", line_passes))
    out = repeat_words(out, "_ln_w", "n_repeat_words")
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    n = F.size("_ln_w").cast("long")
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > 50 * n)
    total, left = chars(F.col("_ln_l")), chars(F.col("_ln_p"))
    share = F.when(total > 0, left / total).otherwise(0.0)
    out = (
        out.withColumn("n_words", n)
        .withColumn("word_chars", F.length(F.regexp_replace(text, SPACES, "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_ln_l") - F.size("_ln_d")).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept_share", share)
        .withColumn("clean_text", F.array_join("_ln_p", "\n"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= min_kept))
    )
    return out.drop("_ln_w", "_ln_l", "_ln_d", "_ln_p")


def op4_line_first_rules(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_lines(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.length("clean_text").cast("long").alias("clean_chars"))


def _re2(pattern: str) -> str:
    return pattern.encode().decode("unicode_escape") if "\\u" in pattern else pattern


OP4_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
n AS (SELECT r, sum(least(3, coalesce(i - before, 3)))::BIGINT AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM p) GROUP BY r),
ln AS (SELECT r, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+').len() AS k FROM (SELECT r, unnest(list_distinct(l)) AS x FROM d)),
ok AS (
  SELECT r, sum(length(x))::BIGINT AS left_chars, count(*) AS n_lines FROM ln
  WHERE NOT (len(regexp_extract_all(x, '{_re2(NAVIGATION)}')) >= 3 AND len(regexp_extract_all(x, '{_re2(NAVIGATION)}')) * 5 >= k
          OR k >= 5 AND NOT regexp_matches(x, '{_re2(SENTENCE)}')
          OR len(regexp_extract_all(x, '{SHOUT}')) >= 1 AND len(regexp_extract_all(x, '{SHOUT}')) * 5 >= k
          OR len(regexp_extract_all(x, '[#*$%&]+')) >= 1 AND len(regexp_extract_all(x, '[#*$%&]+')) * 3 >= k
          OR {" OR ".join(f"k <= {PHRASE_SHARE * n} AND regexp_matches(lower(x), '{p.replace(chr(39), chr(39) * 2)}')" for n, p in phrases())})
  GROUP BY r),
s AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n.n, 0)::BIGINT AS n_repeat_words, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS total,
         coalesce(ok.left_chars, 0) AS left_chars, coalesce(ok.n_lines, 0) AS n_lines
  FROM d LEFT JOIN n USING (r) LEFT JOIN ok USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND total > 0 AND left_chars::DOUBLE / total::DOUBLE >= {MIN_KEPT} AS kept,
       (left_chars + greatest(n_lines - 1, 0))::BIGINT AS clean_chars
FROM b
"""
