"""Terms of documents: frequent words, bigrams, corpus TF-IDF, entities and their graph, keyword usage.

Long form: a row for each document and term. Words are counted within their document's row; ranks are windows
within a document, so no task sees more than a document's terms. Ties go by the term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons as lex
from ..functions import text as tx
from .counting import counted, joined_runs, one_row_an_id


def _top(counted: DataFrame, id_col: str, by: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(by), "term"))
    return counted.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def top_terms(df: DataFrame, k: int = 10, id_col: str = "doc_id") -> DataFrame:
    """The k most frequent words of more than two letters that are no stop words."""
    words = F.filter(tx.lower(F.col("words")), lambda w: (F.length(w) > 2) & ~w.isin(*lex.STOPWORDS))
    return _top(counted(df, id_col, words, top=k), id_col, "frequency", k)


def keyword_density(df: DataFrame, k: int = 10, id_col: str = "doc_id") -> DataFrame:
    """The k top words with their share of all words, in percent."""
    total = df.select(id_col, F.size("words").alias("word_count"))
    found = top_terms(df.select(id_col, "words"), k, id_col).join(total, id_col)
    return found.withColumn("density", tx.ratio(F.col("frequency") * 100, F.col("word_count")))


def section_terms(df: DataFrame, k: int = 5, id_col: str = "doc_id", least: int = 100) -> DataFrame:
    """The k most frequent words of each section: a fifth of the text, but `least` words at least."""
    size = F.greatest(F.lit(least), F.floor(F.size("words") / 5).cast("int")).alias("size")
    words = df.select(id_col, size, F.posexplode(tx.lower(F.col("words"))).alias("place", "term")).where((F.length("term") > 2) & ~F.col("term").isin(*lex.STOPWORDS))
    n = words.groupBy(id_col, F.floor(F.col("place") / F.col("size")).alias("section"), "term").agg(F.count(F.lit(1)).alias("frequency"))
    rank = F.row_number().over(Window.partitionBy(id_col, "section").orderBy(F.desc("frequency"), "term"))
    return n.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def bigrams(df: DataFrame, least: int = 3, threshold: float = 10.0, id_col: str = "doc_id") -> DataFrame:
    """Word pairs with score (n_ab - least) * vocabulary / (n_a * n_b) over the threshold."""
    pairs = counted(df, id_col, tx.lower(F.col("words")), (2,), least, parts=True)
    score = (F.col("frequency") - least) * F.col("vocabulary").cast("double") / (F.col("n_a") * F.col("n_b"))
    return pairs.withColumn("score", score).where(F.col("score") > threshold).select(id_col, "term", "frequency", "score")


def merged_bigrams(df: DataFrame, k: int = 15, id_col: str = "doc_id") -> DataFrame:
    """How often each phrase of `bigrams` stands when words are joined from the left and none is in two phrases; the k most frequent,
    with their share of all words in percent. In a run of words that could be joined throughout every second place begins a phrase."""
    phrases = bigrams(df, id_col=id_col).groupBy(id_col).agg(F.collect_list("term").alias("phrases"))
    rows = one_row_an_id(df, id_col, tx.lower(F.col("words"))).join(phrases, id_col)
    n = joined_runs(rows, id_col).join(df.select(id_col, F.size("words").alias("n")), id_col)
    return _top(n.withColumn("score", tx.ratio(F.col("frequency") * 100, F.col("n"))).drop("n"), id_col, "frequency", k)


def pos_tags(df: DataFrame, out: str = "pos") -> DataFrame:
    """A tag for each token; without a model it is X throughout."""
    return df.withColumn(out, F.transform("toks", lambda t: F.struct(t.alias("token"), F.lit("X").alias("tag"))))


def tfidf(df: DataFrame, k: int = 10, id_col: str = "doc_id") -> DataFrame:
    """The k words of most tf * ln((1 + documents) / (1 + df)) + 1 weight over the corpus."""
    from .vectors import term_weights

    # Rounded before the ranks, so that engines whose logarithms differ in the last bit rank alike.
    scored = term_weights(df, id_col).withColumn("score", F.round("weight", 9))
    return _top(scored, id_col, "score", k).select(id_col, "term", "tf", "df", "rank")


def entities(df: DataFrame, k: int = 50, id_col: str = "doc_id") -> DataFrame:
    """Capitalised words that are no stop words, counted without case; the k most frequent."""
    named = F.transform(F.filter("words", lambda w: w.rlike(r"^\p{Lu}") & (F.length(w) > 1)), lambda w: F.lower(w))
    named = F.filter(named, lambda w: ~w.isin(*lex.STOPWORDS))
    return _top(counted(df, id_col, named, top=k), id_col, "frequency", k)


def entity_nodes(df: DataFrame) -> DataFrame:
    """The nodes of the graph: entities with how often they stand in the corpus."""
    words = df.select(F.explode("words").alias("word")).where(F.col("word").rlike(r"^\p{Lu}") & (F.length("word") > 1))
    return words.groupBy(F.lower("word").alias("term")).agg(F.count(F.lit(1)).alias("weight")).where(~F.col("term").isin(*lex.STOPWORDS))


#: Words within which entities go together; a sentence is seldom longer, but a text without marks is one sentence.
STRETCH = 60


def entity_graph(df: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Entities that stand in one sentence, fewer than `stretch` words apart: (source, target, weight) with source < target, where the weight is the
    number of sentences. A window slides over the places of a sentence's entities, so that no cut parts a pair and pairs are linear in the words; each pair
    of a sentence counts once, however often it is met again."""
    sentences = df.select(F.explode("sents").alias("s")).select(F.regexp_extract_all("s", F.lit(r"\p{L}+"), F.lit(0)).alias("w"))
    named = F.filter(F.transform("w", lambda w, i: F.struct(i.alias("at"), F.lower(w).alias("e"), (w.rlike(r"^\p{Lu}") & (F.length(w) > 1)).alias("is_name"))), lambda x: x["is_name"] & ~x["e"].isin(*lex.STOPWORDS))
    ahead = lambda x, i: F.filter(F.slice("n", i + 2, F.lit(stretch)), lambda y: (y["at"] - x["at"] < stretch) & (y["e"] != x["e"]))
    joined = lambda x, y: F.concat(F.least(x["e"], y["e"]), F.lit(" "), F.greatest(x["e"], y["e"]))
    pairs = F.flatten(F.transform("n", lambda x, i: F.transform(ahead(x, i), lambda y: joined(x, y))))
    each = sentences.select(named.alias("n")).where(F.size("n") > 1).select(F.explode(F.array_distinct(pairs)).alias("pair"))
    cut = F.split("pair", " ")
    return each.groupBy("pair").agg(F.count(F.lit(1)).alias("weight")).select(cut[0].alias("source"), cut[1].alias("target"), "weight")


def keyword_usage(df: DataFrame, id_col: str = "doc_id", k: int = 10) -> DataFrame:
    """Of each document's top words: count, density over its words that are no stop words, and the issue it makes."""
    usable = F.size(F.filter(tx.lower(F.col("words")), lambda w: ~w.isin(*lex.STOPWORDS)))
    found = top_terms(df, k, id_col).join(df.select(id_col, usable.alias("usable")), id_col)
    found = found.withColumn("density", tx.ratio(F.col("frequency") * 100, F.col("usable")))
    return found.withColumn("issue", F.when(F.col("density") < 0.5, "rare").when(F.col("density") > 3, "stuffed").otherwise("none")).drop("usable")


def keyword_stuffing(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents where one of the five most common words of over three letters holds more than a tenth of all."""
    top = _top(counted(df, id_col, tx.lower(F.col("words")), top=5), id_col, "frequency", 5).join(df.select(id_col, F.size("words").alias("n")), id_col)
    hit = (F.length("term") > 3) & (F.col("frequency") * 10 > F.col("n"))
    return top.groupBy(id_col).agg(F.max(hit.cast("int")).alias("stuffed"))


def repeated_phrases(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", longer: int = 10) -> DataFrame:
    """(id, term): phrases of three words side by side, none a stop word, of over `longer` characters, that two sentences in a row hold after the first. Sentences end
    with full stops; texts of less than three have none. Sentences are joined by their places: a phrase's places in order, each with the next one."""
    sentences = F.split(F.lower(tx.text_or_empty(F.col(text_col))), r"\.")
    rows = df.select(id_col, sentences.alias("s")).where(F.size("s") >= 3).select(id_col, F.posexplode("s").alias("at", "s"))
    runs = tx.ngrams(F.split("s", " "), 3)
    plain = lambda p: p.rlike(r"^\p{L}+ \p{L}+ \p{L}+$") & (F.length(p) > longer) & ~F.exists(F.split(p, " "), lambda w: w.isin(*lex.STOPWORDS))
    rows = rows.where("at >= 1").select(id_col, "at", F.explode(F.array_distinct(F.filter(runs, plain))).alias("term"))
    following = F.lead("at").over(Window.partitionBy(id_col, "term").orderBy("at"))
    return rows.withColumn("following", following).where(F.col("following") == F.col("at") + 1).select(id_col, "term").distinct()


def stuffed_texts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, stuffed) by either rule: a word over a tenth of all, or a phrase that sentences in a row repeat."""
    words = keyword_stuffing(df, id_col).select(id_col, F.col("stuffed").alias("by_word"))
    phrases = repeated_phrases(df, text_col, id_col).select(id_col).distinct().withColumn("by_phrase", F.lit(1))
    found = df.select(id_col).join(words, id_col, "left").join(phrases, id_col, "left").fillna(0, ["by_word", "by_phrase"])
    return found.withColumn("stuffed", F.greatest("by_word", "by_phrase"))


def stop_words_removed(df: DataFrame, col: str = "words", out: str = "content_words", lang_col: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Without the stop words of the row's language (of all languages without lang_col or for others), and without extra ones."""
    left = lambda listed: F.filter(tx.lower(F.col(col)), lambda w: ~w.isin(*listed, *extra))
    kept = left(lex.STOPWORDS)
    if lang_col:
        kept = F.coalesce(*[F.when(F.col(lang_col) == k, left(v)) for k, v in lex.STOPWORDS_BY_LANGUAGE.items()], kept)
    return df.withColumn(out, kept)


def preprocessed(df: DataFrame, stops: bool = True, punctuation: bool = True, lemmatize: bool = True, lang_col: str | None = None, extra: tuple[str, ...] = (), out: str = "terms") -> DataFrame:
    """Tokens of prepared text in lower case, by choice without punctuation, without stop words, and as lemmas, in that order."""
    df = df.withColumn(out, tx.lower(F.col("words" if punctuation else "toks")))
    df = stop_words_removed(df, out, out, lang_col, extra) if stops else df
    return lemmas(df, out, out) if lemmatize else df


def lemmas(df: DataFrame, col: str = "words", out: str = "lemmas") -> DataFrame:
    """English noun forms by rule: -ies to -y, -sses to -ss, a plural -s off words of over three letters."""
    one = lambda w: F.when(w.rlike("[^aeiou]ies$") & (F.length(w) > 4), F.regexp_replace(w, "ies$", "y")).when(w.endswith("sses"), F.regexp_replace(w, "es$", "")).when(w.rlike("[^su]s$") & (F.length(w) > 3), F.regexp_replace(w, "s$", "")).otherwise(w)
    return df.withColumn(out, F.transform(tx.lower(F.col(col)), one))


def similarity(a, b):
    """Jaccard similarity of two arrays of words, without case; 0 if both are empty."""
    x, y = F.array_distinct(tx.lower(a)), F.array_distinct(tx.lower(b))
    return tx.ratio(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))


def rank_terms(df: DataFrame, k: int = 30, id_col: str = "doc_id") -> DataFrame:
    """Words that are no stop words by their share of those, the plain form of a text rank."""
    n = counted(df, id_col, tx.lower(F.col("words")), out="n").where((F.length("term") > 2) & ~F.col("term").isin(*lex.STOPWORDS))
    total = n.groupBy(id_col).agg(F.sum("n").alias("total"))
    return _top(n.join(total, id_col).withColumn("score", tx.ratio(F.col("n"), F.col("total"))), id_col, "score", k).select(id_col, "term", "score", "rank")


def keywords(df: DataFrame, k: int = 30, id_col: str = "doc_id") -> DataFrame:
    """Every content word's TF-IDF value (of a vector of length one) and its share of the content words, summed; the k best. The method says which
    of the two lists has the word among its own k best. None under 20 words."""
    from .vectors import term_weights

    both = term_weights(df, id_col, least=20)
    own = Window.partitionBy(id_col)
    both = both.withColumns({"s1": F.round(F.col("weight") / F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(own)), 9), "s2": F.round(F.col("tf") / F.sum("tf").over(own), 9)})
    nth = lambda c: F.row_number().over(own.orderBy(F.desc(c), "term"))
    both = both.withColumns({"r1": nth("s1"), "r2": nth("s2")})
    method = F.when((F.col("r1") <= k) & (F.col("r2") <= k), "tfidf+rank").when(F.col("r1") <= k, "tfidf").when(F.col("r2") <= k, "rank").otherwise("sum")
    both = both.withColumns({"score": F.round(F.col("s1") + F.col("s2"), 9), "method": method})
    return _top(both, id_col, "score", k).select(id_col, "term", "score", "method", "rank")


def related_phrases(df: DataFrame, k: int = 10, id_col: str = "doc_id") -> DataFrame:
    """The k most frequent phrases of two or three words that hold none of the document's five top words."""
    phrases = counted(df, id_col, tx.lower(F.col("words")), (2, 3), 2)
    top = top_terms(df, 5, id_col).groupBy(id_col).agg(F.collect_set("term").alias("tops"))
    left = phrases.join(top, id_col, "left").where(~F.coalesce(F.arrays_overlap(F.split("term", " "), "tops"), F.lit(False)))
    return _top(left, id_col, "frequency", k).select(id_col, "term", "frequency", "rank")


def semantic_rules(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each rule that holds, from the densest word, its spread over five sections (the last takes the
    rest), coherence, the two largest topics and entities."""
    from . import text_analysis as ta
    from . import vectors

    top = keyword_density(df.select(id_col, "words"), 1, id_col).select(id_col, "term", "density")
    named = entities(df.select(id_col, "words"), 1, id_col).select(id_col, F.col("frequency").alias("named"))
    of_topics = vectors.topics(df, id_col)[1].select(id_col, "unfocused")
    df = ta.coherence(df).join(top, id_col, "left").join(named, id_col, "left").join(of_topics, id_col, "left")
    low, size = tx.lower(F.col("words")), F.greatest(F.floor(F.size("words") / 5).cast("int"), F.lit(1))
    df = df.withColumn("sr_low", low).withColumn("sr_size", size)
    counts = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.size(F.filter(F.slice("sr_low", (k * F.col("sr_size") + 1).cast("int"), F.when(k < 4, F.col("sr_size")).otherwise(F.greatest(F.size("sr_low"), F.lit(1)))), lambda w: w == F.col("term"))))
    df = df.withColumn("sr_counts", counts)
    return ta.rules(df, [
        ("keyword_rare", "structure", 3, F.col("density") < 1), ("keyword_stuffed", "structure", 2, F.col("density") > 5),
        ("keyword_uneven", "structure", 3, F.array_min("sr_counts") < 0.3 * F.array_max("sr_counts")), ("incoherent", "structure", 2, F.col("coherence") < 0.2),
        ("unfocused", "structure", 2, F.col("unfocused")), ("no_entities", "vocabulary", 4, F.col("named").isNull()),
    ], id_col)
