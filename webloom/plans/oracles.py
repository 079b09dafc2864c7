"""SQL for DuckDB that says the same as the text queries, written on its own."""

from __future__ import annotations

from ..functions import lexicons as lex

quote = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
STOP = quote(lex.STOPWORDS)

TEXT = r"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
         trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '<[^>]+>', ' ', 'g'), '[^\p{L}\p{N}_\s.,!?;:''"()\[\]{}«»–—-]', ' ', 'g'), '\s+', ' ', 'g')) AS n
  FROM documents),
k AS (SELECT *, regexp_extract_all(n, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]') AS toks, list_filter(string_split(regexp_replace(n, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS sents FROM d),
w AS (SELECT *, list_filter(toks, lambda x: regexp_full_match(x, '\p{L}+')) AS words FROM k),
v AS (SELECT *, list_transform(words, lambda x: lower(x)) AS low FROM w)
"""

STATS = r"""
SELECT doc_id, len(words)::BIGINT AS word_count, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS character_count, length(n)::BIGINT AS characters_with_spaces,
       len(sents)::BIGINT AS sentence_count, len(list_filter(regexp_split_to_array(t, '\n\s*\n'), lambda p: regexp_matches(p, '\S')))::BIGINT AS paragraph_count,
       CASE WHEN len(sents) = 0 THEN 0.0 ELSE len(words)::DOUBLE / len(sents) END AS avg_sentence_length,
       CASE WHEN len(words) = 0 THEN 0.0 ELSE list_sum(list_transform(words, lambda x: length(x)))::DOUBLE / len(words) END AS avg_word_length,
       CASE WHEN len(words) = 0 THEN 0.0 ELSE len(list_distinct(low))::DOUBLE / len(words) END AS lexical_diversity,
       len(list_filter(toks, lambda x: x IN ('.', ',', ';', ':', '!', '?', '(', ')', '[', ']', '{', '}', '"', '''')))::BIGINT AS punctuation_count,
       len(list_filter(toks, lambda x: regexp_full_match(x, '\p{Nd}+')))::BIGINT AS number_count, len(list_filter(words, lambda x: length(x) > 6))::BIGINT AS long_word_count,
       CASE WHEN len(toks) = 0 THEN 0.0 ELSE len(list_filter(toks, lambda x: x IN ('.', ',', ';', ':', '!', '?', '(', ')', '[', ']', '{', '}', '"', '''')))::DOUBLE / len(toks) END AS punctuation_density,
       CASE WHEN len(words) = 0 THEN 0.0 ELSE (len(list_filter(words, lambda x: length(x) > 6)) * 100)::DOUBLE / len(words) END AS long_word_percent
FROM v
"""

READ = r"""
, y AS (
  SELECT *, list_transform(low, lambda x: CASE WHEN length(x) <= 3 THEN 1 ELSE greatest(len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN x LIKE '%e' THEN 1 ELSE 0 END, 1) END) AS syl,
         list_transform(low, lambda x: greatest(len(regexp_extract_all(x, '[аеёиоуыэюя]')), 1)) AS ru, len(words)::DOUBLE AS nw, greatest(len(sents), 1)::DOUBLE AS ns FROM v),
z AS (SELECT *, nw / ns AS asl, coalesce(list_sum(syl), 0)::BIGINT AS syllable_count, len(list_filter(syl, lambda x: x >= 3))::BIGINT AS complex_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::DOUBLE AS c, coalesce(list_sum(ru), 0)::DOUBLE AS nru, (len(list_filter(ru, lambda x: x >= 3)) * 100)::DOUBLE AS hru FROM y),
q AS (SELECT *, CASE WHEN nw = 0 THEN 0.0 ELSE syllable_count::DOUBLE / nw END AS asw, CASE WHEN nw = 0 THEN 0.0 ELSE nru / nw END AS asr FROM z),
r AS (
  SELECT doc_id, lang, nw, syllable_count, complex_words, 206.835::DOUBLE - 1.015::DOUBLE * asl - 84.6::DOUBLE * asw AS flesch_reading_ease, 0.39::DOUBLE * asl + 11.8::DOUBLE * asw - 15.59::DOUBLE AS flesch_kincaid_grade,
         0.4::DOUBLE * (asl + CASE WHEN nw = 0 THEN 0.0 ELSE (complex_words * 100)::DOUBLE / nw END) AS gunning_fog, 1.043::DOUBLE * sqrt(complex_words * 30.0::DOUBLE / ns) + 3.1291::DOUBLE AS smog_index,
         4.71::DOUBLE * CASE WHEN nw = 0 THEN 0.0 ELSE c / nw END + 0.5::DOUBLE * asl - 21.43::DOUBLE AS automated_readability_index,
         CASE WHEN (nw + 2 * complex_words) / ns > 20 THEN (nw + 2 * complex_words) / ns / 2 ELSE ((nw + 2 * complex_words) / ns - 2) / 2 END::DOUBLE AS linsear_write,
         0.1579::DOUBLE * CASE WHEN nw = 0 THEN 0.0 ELSE (complex_words * 100)::DOUBLE / nw END + 0.0496::DOUBLE * asl + CASE WHEN nw > 0 AND (complex_words * 100)::DOUBLE / nw > 5 THEN 3.6365::DOUBLE ELSE 0.0::DOUBLE END AS dale_chall,
         5.88::DOUBLE * CASE WHEN nw = 0 THEN 0.0 ELSE c / nw END - 29.6::DOUBLE * CASE WHEN nw = 0 THEN 0.0 ELSE ns / nw END - 15.8::DOUBLE AS coleman_liau_index,
         least(greatest(206.835::DOUBLE - 1.3::DOUBLE * asl - 60.1::DOUBLE * asr, 0.0), 100.0) AS flesch_ru, 0.4::DOUBLE * (asl + CASE WHEN nw = 0 THEN 0.0 ELSE hru / nw END) AS fog_ru FROM q),
o AS (SELECT *, CASE WHEN nw = 0 THEN 50.0 WHEN lang = 'ru' THEN flesch_ru ELSE flesch_reading_ease END::DOUBLE AS overall_readability FROM r)
"""

READ_OUT = r"""
SELECT doc_id, syllable_count, complex_words, flesch_reading_ease, flesch_kincaid_grade, gunning_fog, smog_index, automated_readability_index, coleman_liau_index, linsear_write, dale_chall, flesch_ru, fog_ru, overall_readability,
       CASE WHEN overall_readability >= 90 THEN '5th grade' WHEN overall_readability >= 80 THEN '6th grade' WHEN overall_readability >= 70 THEN '7th grade' WHEN overall_readability >= 60 THEN '8th to 9th grade'
            WHEN overall_readability >= 50 THEN '10th to 12th grade' WHEN overall_readability >= 30 THEN 'college' ELSE 'graduate' END AS education_level,
       CASE WHEN overall_readability >= 90 THEN 'very easy' WHEN overall_readability >= 80 THEN 'easy' WHEN overall_readability >= 70 THEN 'fairly easy' WHEN overall_readability >= 60 THEN 'standard'
            WHEN overall_readability >= 50 THEN 'fairly difficult' WHEN overall_readability >= 30 THEN 'difficult' ELSE 'very difficult' END AS readability_level FROM o
"""

QUALITY = READ + ", st AS (" + STATS + r""")
SELECT o.doc_id, least(greatest(0.4::DOUBLE * o.overall_readability + 0.3::DOUBLE * 100.0::DOUBLE * st.lexical_diversity + 0.3::DOUBLE * 100.0::DOUBLE, 0.0), 100.0) AS overall_quality
FROM o JOIN st USING (doc_id)"""

BASIC_RULES = READ + ", st AS (" + STATS + r"""),
b AS (SELECT * FROM o JOIN st USING (doc_id)),
x AS (
  SELECT doc_id, 0 AS rule_order, 'long_sentences' AS code, 'readability' AS category, 2 AS priority FROM b WHERE avg_sentence_length > 25
  UNION ALL SELECT doc_id, 1, 'low_readability', 'readability', 1 FROM b WHERE (CASE WHEN coalesce(lang, '') = 'ru' THEN flesch_ru ELSE flesch_reading_ease END) < 50 AND word_count > 0
  UNION ALL SELECT doc_id, 2, 'low_diversity', 'vocabulary', 3 FROM b WHERE lexical_diversity < 0.4
  UNION ALL SELECT doc_id, 3, 'high_diversity', 'vocabulary', 4 FROM b WHERE lexical_diversity > 0.8 AND word_count > 300
  UNION ALL SELECT doc_id, 5, 'long_paragraphs', 'structure', 3 FROM b WHERE paragraph_count > 0 AND sentence_count::DOUBLE / paragraph_count > 7)
SELECT * FROM x"""

TERMS = f"""
, f AS (SELECT doc_id, term, count(*) AS frequency FROM (SELECT doc_id, unnest(low) AS term FROM v) WHERE length(term) > 2 AND term NOT IN ({STOP}) GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, term) AS rank FROM f QUALIFY rank <= 10)
"""
TOP_TERMS = TERMS + "SELECT doc_id, term, frequency, rank FROM top"
DENSITY = TERMS + "SELECT doc_id, term, frequency, rank, len(words)::BIGINT AS word_count, (frequency * 100)::DOUBLE / len(words) AS density FROM top JOIN v USING (doc_id)"
TFIDF = f"""
, f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(low) AS term FROM v) WHERE length(term) > 2 AND term NOT IN ({STOP}) GROUP BY 1, 2),
n AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
s AS (SELECT *, round(tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM v)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE), 9) AS score FROM f JOIN n USING (term))
SELECT doc_id, term, tf, df, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s QUALIFY rank <= 10"""
BIGRAMS = """
, p AS (SELECT doc_id, a, b, count(*) AS frequency FROM (SELECT doc_id, low[i] AS a, low[i + 1] AS b FROM (SELECT doc_id, low, unnest(range(1, len(low))) AS i FROM v)) GROUP BY ALL HAVING count(*) >= 3),
u AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(low) AS x FROM v) GROUP BY ALL),
z AS (SELECT doc_id, count(*) AS vocabulary FROM u GROUP BY 1)
SELECT p.doc_id, p.a || ' ' || p.b AS term, frequency, (frequency - 3) * vocabulary::DOUBLE / (ua.n * ub.n) AS score
FROM p JOIN u ua ON ua.doc_id = p.doc_id AND ua.x = a JOIN u ub ON ub.doc_id = p.doc_id AND ub.x = b JOIN z ON z.doc_id = p.doc_id
WHERE (frequency - 3) * vocabulary::DOUBLE / (ua.n * ub.n) > 10.0"""
MERGED = BIGRAMS.replace("\nSELECT p.doc_id,", ",\nbg AS (SELECT p.doc_id,", 1) + """),
q AS (SELECT doc_id, place, low[place + 1] || ' ' || low[place + 2] AS term FROM (SELECT doc_id, low, unnest(range(len(low))) AS place FROM v)),
r AS (SELECT q.*, bg.term IS NOT NULL AS is_phrase FROM q LEFT JOIN bg ON bg.doc_id = q.doc_id AND bg.term = q.term),
t AS (SELECT *, coalesce(max(CASE WHEN NOT is_phrase THEN place END) OVER (PARTITION BY doc_id ORDER BY place), -1) AS last FROM r),
g AS (SELECT doc_id, term, count(*) AS frequency FROM t WHERE is_phrase AND (place - last) % 2 = 1 GROUP BY 1, 2)
SELECT doc_id, term, frequency, (frequency * 100)::DOUBLE / len(words) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, term) AS rank FROM g JOIN v USING (doc_id) QUALIFY rank <= 15"""
ENTITIES = f"""
, f AS (SELECT doc_id, lower(word) AS term, count(*) AS frequency FROM (SELECT doc_id, unnest(words) AS word FROM v) WHERE regexp_matches(word, '^\\p{{Lu}}') AND length(word) > 1 AND lower(word) NOT IN ({STOP}) GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, term) AS rank FROM f QUALIFY rank <= 50"""
GRAPH = f"""
, s AS (SELECT row_number() OVER () AS r, regexp_extract_all(s, '\\p{{L}}+') AS w FROM (SELECT unnest(sents) AS s FROM v)),
m AS (SELECT r, place, lower(x) AS x FROM (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS place FROM s) WHERE regexp_matches(x, '^\\p{{Lu}}') AND length(x) > 1 AND lower(x) NOT IN ({STOP})),
p AS (SELECT DISTINCT a.r, least(a.x, b.x) AS source, greatest(a.x, b.x) AS target FROM m a JOIN m b ON a.r = b.r AND b.place > a.place AND b.place < a.place + 60 AND a.x <> b.x)
SELECT source, target, count(*) AS weight FROM p GROUP BY 1, 2"""
USAGE = TERMS + f"""
, g AS (SELECT doc_id, len(list_filter(low, lambda x: x NOT IN ({STOP}))) AS usable FROM v)
SELECT doc_id, term, frequency, rank, (frequency * 100)::DOUBLE / usable AS density, CASE WHEN (frequency * 100)::DOUBLE / usable < 0.5 THEN 'rare' WHEN (frequency * 100)::DOUBLE / usable > 3 THEN 'stuffed' ELSE 'none' END AS issue FROM top JOIN g USING (doc_id)"""
STUFFED = """
, f AS (SELECT doc_id, term, count(*) AS frequency FROM (SELECT doc_id, unnest(low) AS term FROM v) GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, term) AS rank FROM f QUALIFY rank <= 5)
SELECT doc_id, max(CASE WHEN length(term) > 3 AND frequency * 10 > len(words) THEN 1 ELSE 0 END)::INTEGER AS stuffed FROM top JOIN v USING (doc_id) GROUP BY 1"""

_TURNED = f"x[2] IN ({quote(lex.NEGATIONS)})"
_GOOD, _BAD = f"x[1] IN ({quote(lex.POSITIVE)})", f"x[1] IN ({quote(lex.NEGATIVE)})"
_HITS = lambda words, cond: f"len(list_filter(list_zip({words}, list_concat([''], {words}[1:-2])), lambda x: {cond}))"
_FEEL = lambda words: f"(({_HITS(words, f'({_GOOD} AND NOT {_TURNED}) OR (NOT {_GOOD} AND {_BAD} AND {_TURNED})')} - {_HITS(words, f'({_GOOD} AND {_TURNED}) OR (NOT {_GOOD} AND {_BAD} AND NOT {_TURNED})')})::DOUBLE / ({_HITS(words, f'{_GOOD} OR {_BAD}')} + 1))"
_LABEL = lambda c: f"CASE WHEN {c} >= 0.05 THEN 'positive' WHEN {c} <= -0.05 THEN 'negative' ELSE 'neutral' END"
SENTIMENT = f"""
, c AS (SELECT doc_id, {_FEEL('low')} AS compound FROM v),
s AS (SELECT doc_id, regexp_extract_all(lower(s), '\\p{{L}}+') AS ws FROM (SELECT doc_id, unnest(sents) AS s FROM v) WHERE len(regexp_extract_all(s, '\\p{{L}}+')) >= 5),
l AS (SELECT doc_id, {_LABEL('f')} AS label FROM (SELECT doc_id, {_FEEL('ws')} AS f FROM s)),
g AS (SELECT doc_id, count(*)::DOUBLE AS n, count(*) FILTER (label = 'positive') AS p, count(*) FILTER (label = 'negative') AS m, count(*) FILTER (label = 'neutral') AS u FROM l GROUP BY 1)
SELECT doc_id, compound, {_LABEL('compound')} AS sentiment, coalesce(p / n, 0.0)::DOUBLE AS positive_share, coalesce(m / n, 0.0)::DOUBLE AS negative_share, coalesce(u / n, 1.0)::DOUBLE AS neutral_share FROM c LEFT JOIN g USING (doc_id)"""
EMOTIONS = ", e AS (SELECT doc_id, len(toks) AS n, " + ", ".join(f"len(list_filter(toks, lambda x: lower(x) IN ({quote(v)})))::BIGINT AS {k}" for k, v in lex.EMOTIONS.items()) + f""" FROM v)
SELECT doc_id, {', '.join(lex.EMOTIONS)}, CASE {' '.join(f"WHEN {k} = greatest({', '.join(lex.EMOTIONS)}) THEN '{k}'" for k in lex.EMOTIONS)} END AS dominant_emotion,
       CASE WHEN n = 0 THEN 0.0 ELSE ({' + '.join(lex.EMOTIONS)})::DOUBLE / n END AS emotional_intensity FROM e"""
CTA = ", c AS (SELECT doc_id, flatten([" + ", ".join(f"regexp_extract_all(lower(t), '{p}')" for p in lex.CTA_PATTERNS) + "]) AS ctas FROM v),\nh AS (SELECT doc_id, len(ctas) AS n, [" + ", ".join("coalesce(list_sum(list_transform(ctas, lambda c: " + " + ".join("contains(c, '" + w.replace("'", "''") + "')::INTEGER" for w in v) + ")), 0)" for v in lex.CTA_TRIGGERS.values()) + f"""] AS hits FROM c)
SELECT doc_id, n::BIGINT AS cta_count, array_to_string(list_transform(list_filter(list_zip([{quote(lex.CTA_TRIGGERS)}], hits), lambda x: x[2] > 0), lambda x: x[1]), ',') AS cta_triggers,
       CASE WHEN n = 0 THEN 0.0 ELSE 100.0::DOUBLE * (0.6::DOUBLE * len(list_filter(hits, lambda x: x > 0)) / 6.0::DOUBLE + 0.4::DOUBLE * least(1.0::DOUBLE, list_sum(hits)::DOUBLE / (2 * n))) END::DOUBLE AS cta_effectiveness FROM h"""
UX = r"""
, g AS (
  SELECT doc_id, CASE WHEN len(sents) = 0 THEN 0.0 ELSE len(words)::DOUBLE / len(sents) END AS asl, CASE WHEN len(words) = 0 THEN 0.0 ELSE (len(list_filter(words, lambda x: length(x) > 6)) * 100)::DOUBLE / len(words) END AS hard,
         len(list_filter(sents, lambda s: len(regexp_extract_all(s, '\p{L}+')) > 25))::BIGINT AS long_sentences, len(list_filter(regexp_extract_all(t, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][A-Z]+')))::BIGINT AS caps, len(regexp_extract_all(t, '!'))::BIGINT AS exclamations,
         len(regexp_extract_all(t, '\.\.\.'))::BIGINT AS ellipses, CASE WHEN len(toks) = 0 THEN 0.0 ELSE coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::DOUBLE / len(toks) END AS w, CASE WHEN len(sents) = 0 THEN 0.0 ELSE len(toks)::DOUBLE / len(sents) END AS s,
         list_filter(regexp_split_to_array(lower(t), '\s+'), lambda x: x <> '') AS parts FROM v),
tri AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, parts[i] || ' ' || parts[i + 1] || ' ' || parts[i + 2] AS x FROM (SELECT doc_id, parts, unnest(range(1, len(parts) - 1)) AS i FROM g) GROUP BY ALL HAVING count(*) > 2) GROUP BY 1),
b AS (
  SELECT g.doc_id, long_sentences, 100.0::DOUBLE - CASE WHEN asl > 25 THEN 30 WHEN asl > 20 THEN 20 WHEN asl > 15 THEN 10 ELSE 0 END - CASE WHEN hard > 30 THEN 30 WHEN hard > 20 THEN 20 WHEN hard > 10 THEN 10 ELSE 0 END AS clarity,
         caps, exclamations, ellipses, coalesce(tri.n, 0)::BIGINT AS repeated_trigrams,
         least(greatest(70.0::DOUBLE + CASE WHEN w > 6 THEN -20 WHEN w < 4 THEN 10 ELSE 0 END + CASE WHEN s > 20 THEN -20 WHEN s < 10 THEN 10 ELSE 0 END, 0), 100) AS audience_fit FROM g LEFT JOIN tri USING (doc_id)),
c AS (SELECT *, least(100.0::DOUBLE, 20.0::DOUBLE * ((caps > 3)::INTEGER + (exclamations > 5)::INTEGER + (ellipses > 5)::INTEGER + (repeated_trigrams > 0)::INTEGER)) AS distraction_level FROM b)
SELECT doc_id, long_sentences, clarity, caps, exclamations, ellipses, repeated_trigrams, distraction_level, audience_fit, 0.4::DOUBLE * clarity + 0.3::DOUBLE * (100.0::DOUBLE - distraction_level) + 0.3::DOUBLE * audience_fit AS ux_score FROM c"""
COHERENCE = r"""
, s AS (SELECT doc_id, list_transform(sents, lambda s: list_distinct(regexp_extract_all(lower(s), '\p{L}+'))) AS sets FROM v),
p AS (SELECT doc_id, i, sets[i] AS a, sets[i + 1] AS b FROM (SELECT doc_id, sets, unnest(range(1, len(sets))) AS i FROM s)),
j AS (SELECT doc_id, i, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS j FROM p),
m AS (SELECT doc_id, round(avg(j), 6) AS coherence FROM j GROUP BY 1)
SELECT s.doc_id, coalesce(m.coherence, 1.0)::DOUBLE AS coherence FROM s LEFT JOIN m USING (doc_id)"""

RANKED = f"""
, f AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(low) AS term FROM v) WHERE length(term) > 2 AND term NOT IN ({STOP}) GROUP BY 1, 2),
s AS (SELECT doc_id, term, n::DOUBLE / sum(n) OVER (PARTITION BY doc_id) AS score FROM f)
SELECT doc_id, term, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s QUALIFY rank <= 30"""
RELATED = TERMS + """
, t5 AS (SELECT doc_id, list(term) AS tops FROM top WHERE rank <= 5 GROUP BY 1),
g AS (SELECT doc_id, low[i:i + 1] AS ws FROM (SELECT doc_id, low, unnest(range(1, len(low))) AS i FROM v) UNION ALL SELECT doc_id, low[i:i + 2] FROM (SELECT doc_id, low, unnest(range(1, len(low) - 1)) AS i FROM v)),
n AS (SELECT doc_id, ws, count(*) AS frequency FROM g GROUP BY 1, 2 HAVING count(*) > 1),
kk AS (SELECT n.doc_id, array_to_string(ws, ' ') AS term, frequency FROM n LEFT JOIN t5 USING (doc_id) WHERE NOT coalesce(list_has_any(ws, tops), false))
SELECT doc_id, term, frequency, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, term) AS rank FROM kk QUALIFY rank <= 10"""
CONTENT_WORDS = f"""SELECT doc_id, len(list_filter(low, lambda x: x NOT IN ({STOP})))::BIGINT AS content_words, md5(array_to_string(list_filter(low, lambda x: x NOT IN ({STOP})), ' ')) AS content_md5 FROM v"""

PAGE_BARE = r"""
WITH h AS (SELECT page_id, url, coalesce(html, '') AS html, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '<\1></\1>', 'gs') AS bare FROM pages)
"""

_COMMON = {k: v for k, v in lex.STOPWORDS_BY_LANGUAGE.items() if k != "ru"}
LANGUAGE = f"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS ws FROM documents),
c AS (SELECT *, {', '.join(f"len(list_filter(ws, lambda x: x IN ({quote(v)}))) AS n_{k}" for k, v in _COMMON.items())} FROM w),
g AS (SELECT *, greatest({', '.join(f'n_{k}' for k in _COMMON)}) AS best FROM c)
SELECT doc_id, lang, CASE WHEN length(trim(t)) < 10 THEN 'en' WHEN len(regexp_extract_all(t, '[Ѐ-ӿ]')) * 2 > length(t) THEN 'ru' WHEN best = 0 THEN 'en' {' '.join(f"WHEN n_{k} = best THEN '{k}'" for k in _COMMON)} END AS detected_lang FROM g"""

KEYWORDS = f"""
, l AS (SELECT doc_id, low FROM v WHERE len(words) >= 20),
f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(low) AS term FROM l) WHERE length(term) > 2 AND term NOT IN ({STOP}) GROUP BY 1, 2),
n AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
q AS (SELECT doc_id, term, tf, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM l)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS a FROM f JOIN n USING (term)),
s AS (SELECT doc_id, term, round(a / sqrt(sum(a * a) OVER (PARTITION BY doc_id)), 9) AS a, round(tf::DOUBLE / sum(tf) OVER (PARTITION BY doc_id), 9) AS b FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC, term) AS ra, row_number() OVER (PARTITION BY doc_id ORDER BY b DESC, term) AS rb FROM s),
m AS (SELECT doc_id, term, round(a + b, 9) AS score, CASE WHEN ra <= 30 AND rb <= 30 THEN 'tfidf+rank' WHEN ra <= 30 THEN 'tfidf' WHEN rb <= 30 THEN 'rank' ELSE 'sum' END AS method FROM r)
SELECT doc_id, term, score, method, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM m QUALIFY rank <= 30"""

ALL_RULES = f"""
WITH b0 AS ({TEXT + BASIC_RULES}), se AS ({TEXT + SENTIMENT}), em AS ({TEXT + EMOTIONS}), ct AS ({TEXT + CTA}), ux AS ({TEXT + UX})
SELECT doc_id, rule_order, code, CASE WHEN category = 'structure' THEN 'structure' ELSE 'content' END AS category, priority FROM b0
UNION ALL SELECT doc_id, 6, 'negative_tone', 'content', 2 FROM se WHERE sentiment = 'negative'
UNION ALL SELECT doc_id, 7, 'too_neutral', 'content', 4 FROM se WHERE neutral_share > 0.8
UNION ALL SELECT doc_id, 8, 'low_emotion', 'content', 4 FROM em WHERE emotional_intensity < 0.05
UNION ALL SELECT doc_id, 9, 'no_cta', 'conversion', 2 FROM ct WHERE cta_count = 0
UNION ALL SELECT doc_id, 10, 'weak_cta', 'conversion', 3 FROM ct WHERE cta_count > 0 AND cta_effectiveness < 40
UNION ALL SELECT doc_id, 11, 'unclear', 'ux', 2 FROM ux WHERE clarity < 60
UNION ALL SELECT doc_id, 12, 'distracting', 'ux', 3 FROM ux WHERE distraction_level > 40
UNION ALL SELECT doc_id, 13, 'poor_fit', 'ux', 3 FROM ux WHERE audience_fit < 60"""

ROBOTS = r"""
WITH p AS (SELECT page_id, url, coalesce(nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*(.*)$', 1), ''), '/') AS path FROM pages)
SELECT page_id, url, starts_with(path, '/private/open') OR NOT (starts_with(path, '/private') OR regexp_matches(path, '^/.*\.pdf')) AS allowed FROM p"""

LINKS_TOTAL = PAGE_BARE + r"""
, a AS (SELECT page_id, url AS base, unnest(regexp_extract_all(bare, '<a href="([^"]*)"', 1)) AS href FROM h),
k AS (SELECT page_id, base, replace(href, '&amp;', '&') AS href FROM a WHERE href <> '' AND NOT regexp_matches(lower(trim(href)), '^(javascript:|#|mailto:|tel:)'))
SELECT page_id, count(*) AS links, count(*) FILTER (NOT regexp_matches(href, '^([a-z]+:)?//') OR regexp_extract(href, '//([^/?#]*)', 1) = regexp_extract(base, '//([^/?#]*)', 1)) AS internal FROM k GROUP BY 1"""

_GIVEN = ("the", "of the", "que", "zzz")
_IN = "CASE WHEN contains(k, ' ') THEN ((length({t}) - length(replace({t}, k, ''))) // length(k))::BIGINT ELSE len(list_filter({w}, lambda x: x = k))::BIGINT END"
GIVEN_KEYWORDS = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS t, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS ws FROM documents),
z AS (SELECT *, greatest(len(ws) // 4, 1) AS n, len(list_filter(ws, lambda x: x NOT IN ({STOP})))::BIGINT AS usable FROM w),
p AS (SELECT *, ws[1:n] AS p1, ws[n + 1:2 * n] AS p2, ws[2 * n + 1:3 * n] AS p3, ws[3 * n + 1:] AS p4 FROM z),
k AS (SELECT *, unnest([{quote(_GIVEN)}]) AS k, unnest(range(1, {len(_GIVEN) + 1})) AS place FROM p),
c AS (SELECT *, {_IN.format(t="t", w="ws")} AS cnt, {", ".join(_IN.format(t=f"array_to_string(p{i}, ' ')", w=f"p{i}") + f" AS c{i}" for i in (1, 2, 3, 4))} FROM k),
d AS (SELECT *, CASE WHEN usable = 0 THEN 0.0::DOUBLE ELSE (cnt * 100)::DOUBLE / usable END AS density FROM c),
i AS (SELECT *, CASE WHEN cnt = 0 THEN 'missing:' || k WHEN density < 0.5 THEN 'rare:' || k WHEN density > 3 THEN 'stuffed:' || k WHEN len(ws) >= 300 AND least(c1, c2, c3, c4) = 0 THEN 'uneven:' || k END AS issue FROM d),
s AS (SELECT r, coalesce(string_agg(issue, '|' ORDER BY place), '') AS issues, greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.1::DOUBLE * count(issue)) AS keyword_score FROM i GROUP BY r)
SELECT doc_id, keyword_score, k AS keyword, cnt AS count, density, concat_ws('|', c1, c2, c3, c4) AS by_section, issues FROM i JOIN s USING (r)"""

EMOTION_PROFILE = ", e AS (SELECT doc_id, sents, " + ", ".join(f"len(list_filter(toks, lambda x: lower(x) IN ({quote(v)})))::BIGINT AS {k}" for k, v in lex.EMOTIONS.items()) + f""" FROM v),
t AS (SELECT *, ({' + '.join(lex.EMOTIONS)})::DOUBLE AS total FROM e)
SELECT doc_id, {', '.join(f"CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE {k} / total END AS {k}_share, len(list_filter(sents, lambda s: regexp_matches(lower(s), '{'|'.join(v)}')))::BIGINT AS {k}_sentences" for k, v in lex.EMOTIONS.items())} FROM t"""
SECTION_TERMS = f"""
, w2 AS (SELECT doc_id, low, greatest(100, len(low) // 5) AS size FROM v),
x AS (SELECT doc_id, size, unnest(low) AS term, unnest(range(len(low))) AS place FROM w2),
f AS (SELECT doc_id, (place // size)::BIGINT AS section, term, count(*) AS frequency FROM x WHERE length(term) > 2 AND term NOT IN ({STOP}) GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY frequency DESC, term) AS rank FROM f QUALIFY rank <= 5"""
GRAPH_NODES = f"""
, f AS (SELECT lower(word) AS term, count(*) AS weight FROM (SELECT unnest(words) AS word FROM v) WHERE regexp_matches(word, '^\\p{{Lu}}') AND length(word) > 1 AND lower(word) NOT IN ({STOP}) GROUP BY 1)
SELECT * FROM f"""
_OWN = "CASE " + " ".join(f"WHEN lang = '{k}' THEN list_filter(low, lambda x: x NOT IN ({quote(v)}))" for k, v in lex.STOPWORDS_BY_LANGUAGE.items()) + f" ELSE list_filter(low, lambda x: x NOT IN ({STOP})) END"
PREPROCESSED = f"""
, g AS (SELECT doc_id, {_OWN} AS ws FROM v),
l AS (SELECT doc_id, list_transform(list_filter(ws, lambda x: x <> 'item'), lambda x: CASE WHEN regexp_matches(x, '[^aeiou]ies$') AND length(x) > 4 THEN regexp_replace(x, 'ies$', 'y') WHEN x LIKE '%sses' THEN regexp_replace(x, 'es$', '') WHEN regexp_matches(x, '[^su]s$') AND length(x) > 3 THEN regexp_replace(x, 's$', '') ELSE x END) AS lemmas FROM g)
SELECT doc_id, len(lemmas)::BIGINT AS n, md5(array_to_string(lemmas, ' ')) AS md5 FROM l"""
SIMILAR_ENDS = r"""
, s AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(sents[1], '')), '\p{L}+')) AS a, list_distinct(regexp_extract_all(lower(coalesce(sents[-1], '')), '\p{L}+')) AS b FROM v)
SELECT doc_id, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS similarity FROM s""".replace("\\\\", "\\")
_SEM = lambda sql, value: f"SELECT doc_id, string_agg({value}, '|' ORDER BY rank) AS said FROM ({TEXT + sql}) GROUP BY doc_id"
SEMANTIC = f"""
WITH kw AS ({_SEM(KEYWORDS, "term")}), en AS ({_SEM(ENTITIES, "term || ':' || frequency")}), co AS ({TEXT + COHERENCE})
SELECT co.doc_id, coalesce(kw.said, '') AS keywords, coalesce(en.said, '') AS entities, round(coherence, 6) AS coherence FROM co LEFT JOIN kw USING (doc_id) LEFT JOIN en USING (doc_id)"""

ANALYSIS = f"""
WITH st AS ({TEXT + STATS}), rd AS ({TEXT + READ + READ_OUT}), qu AS ({TEXT + QUALITY}), se AS ({TEXT + SENTIMENT}), em AS ({TEXT + EMOTIONS}), ct AS ({TEXT + CTA}), ux AS ({TEXT + UX}),
ru AS (SELECT doc_id, string_agg(code, '|' ORDER BY priority, rule_order) AS codes FROM ({ALL_RULES}) GROUP BY doc_id)
SELECT doc_id, documents.lang AS language, word_count, overall_readability, readability_level, overall_quality, sentiment, dominant_emotion, cta_count, ux_score, coalesce(codes, '') AS codes
FROM documents JOIN st USING (doc_id) JOIN rd USING (doc_id) JOIN qu USING (doc_id) JOIN se USING (doc_id) JOIN em USING (doc_id) JOIN ct USING (doc_id) JOIN ux USING (doc_id) LEFT JOIN ru USING (doc_id)"""


#: Given pages as text: unclosed p and b end with the article. P and L stand for chr(57346) and chr(57345), as marks of paragraphs and lines.
MARKDOWN = r"""
WITH m AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<![^>]*>', '', 'g'), '(?s)<head>.*?</head>|<nav>.*?</nav>|<footer>.*?</footer>', '', 'g') AS t FROM pages WHERE html <> ''),
k AS (SELECT page_id, replace(t, '</article>', repeat('**P', len(regexp_extract_all(t, '<b>'))::INTEGER) || '</article>') AS t FROM (SELECT page_id, regexp_replace(regexp_replace(replace(replace(t, 'P', chr(57347)), 'L', chr(57348)), '(>\s*\d+)\.(\s)', '\1\\.\2', 'g'), '(>\s*)([+-])(\s)', '\1\\\2\3', 'g') AS t FROM m)),
g AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '<h1>', 'P# ', 'g'), '<b>', '**', 'g'), '<br>', 'L', 'g'), '</?(p|div|article|h1|body)( [^>]*)?>', 'P', 'g') AS t FROM k),
r AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '[ PL]*P[ PL]*', 'P', 'g'), ' *L[ L]*', 'L', 'g') AS t FROM g),
d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(t, 'P', chr(10) || chr(10)), 'L', chr(10)), chr(57347), 'P'), chr(57348), 'L'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&') AS t FROM r)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, ' +', ' ', 'g'), '</?[a-z][^>]*>', '', 'g'), '^\n+|\s+$', '', 'g') AS text_content FROM d"""

PHRASES = f"""
, pt AS (SELECT doc_id, string_split(lower(coalesce(text, '')), '.') AS s FROM documents),
pe AS (SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS place FROM pt WHERE len(s) >= 3),
pg AS (SELECT doc_id, place, string_split(s, ' ') AS w FROM pe WHERE place >= 1),
ph AS (SELECT DISTINCT doc_id, place, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM pg)),
pk AS (SELECT doc_id, place, a || ' ' || b || ' ' || c AS term FROM ph WHERE {" AND ".join(f"regexp_full_match({x}, '\\p{{L}}+') AND {x} NOT IN ({STOP})" for x in "abc")} AND length(a) + length(b) + length(c) > 8),
pn AS (SELECT DISTINCT x.doc_id, x.term FROM pk x JOIN pk y ON x.doc_id = y.doc_id AND x.term = y.term AND y.place = x.place + 1)"""
PHRASE_STUFFING = PHRASES + f"""
, wd AS ({TEXT + STUFFED})
SELECT v.doc_id, coalesce(wd.stuffed, 0) AS by_word, CASE WHEN v.doc_id IN (SELECT doc_id FROM pn) THEN 1 ELSE 0 END AS by_phrase, greatest(coalesce(wd.stuffed, 0), CASE WHEN v.doc_id IN (SELECT doc_id FROM pn) THEN 1 ELSE 0 END) AS stuffed FROM v LEFT JOIN wd ON v.doc_id = wd.doc_id"""

_CONTENT = f"list_filter(low, lambda x: length(x) > 2 AND x NOT IN ({STOP}))"
RELEVANCE = f"""
, cw AS (SELECT doc_id, words, {_CONTENT} AS c, list_filter(list_transform(regexp_extract_all(coalesce(sents[1], ''), '\\p{{L}}+'), lambda x: lower(x)), lambda x: length(x) > 2 AND x NOT IN ({STOP})) AS first FROM v),
tg AS (SELECT doc_id, unnest(list_concat(first[1:3], [array_to_string(first[1:5], ' ')])) AS phrase FROM cw WHERE len(first) > 0),
tt AS (SELECT DISTINCT doc_id, phrase FROM tg),
rf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(c) AS term FROM cw) GROUP BY 1, 2),
rd AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM v)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM rf GROUP BY 1),
rl AS (SELECT doc_id, sqrt(sum(tf * idf * tf * idf)) AS size FROM rf JOIN rd USING (term) GROUP BY 1),
pw AS (SELECT doc_id, phrase, term, count(*) AS n FROM (SELECT doc_id, phrase, unnest(string_split(phrase, ' ')) AS term FROM tt) GROUP BY ALL),
kn AS (SELECT pw.*, coalesce(idf, ln(1.0::DOUBLE + (SELECT count(*) FROM v)) + 1.0::DOUBLE) AS idf FROM pw LEFT JOIN rd USING (term)),
sm AS (SELECT kn.doc_id, phrase, sum(n * idf * coalesce(tf * idf / size, 0)) / sqrt(sum(n * idf * n * idf)) AS similarity FROM kn LEFT JOIN rl USING (doc_id) LEFT JOIN rf ON rf.doc_id = kn.doc_id AND rf.term = kn.term GROUP BY 1, 2),
gr AS (SELECT doc_id, unnest(c) AS term FROM cw UNION ALL SELECT doc_id, c[i] || ' ' || c[i + 1] FROM (SELECT doc_id, c, unnest(range(1, len(c))) AS i FROM cw) UNION ALL SELECT doc_id, c[i] || ' ' || c[i + 1] || ' ' || c[i + 2] FROM (SELECT doc_id, c, unnest(range(1, len(c) - 1)) AS i FROM cw)),
gk AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term) AS rank FROM gr GROUP BY 1, 2 QUALIFY rank <= 10),
gl AS (SELECT doc_id, list(term ORDER BY rank) AS phrases FROM gk GROUP BY 1),
pd AS (SELECT doc_id, round(avg(similarity), 6) AS topical_relevance, avg(CASE WHEN len(list_filter(coalesce(phrases, []), lambda p: len(list_filter(list_concat([phrase], string_split(phrase, ' ')), lambda w: contains(p, w))) > 0)) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS coverage FROM sm LEFT JOIN gl USING (doc_id) GROUP BY 1),
ro AS (SELECT doc_id, len(words)::BIGINT AS word_count, topical_relevance, coverage, CASE WHEN len(words) < 300 THEN 'thin' WHEN len(words) < 700 THEN 'moderate' ELSE 'in_depth' END AS content_depth, array_to_string(phrases, '|') AS key_phrases FROM cw LEFT JOIN pd USING (doc_id) LEFT JOIN gl USING (doc_id)),
ri AS (SELECT *, list_filter([CASE WHEN word_count = 0 THEN 'no_content' END, CASE WHEN word_count > 0 AND content_depth = 'thin' THEN 'thin_content' END, CASE WHEN topical_relevance < 0.5 THEN 'low_relevance' END, CASE WHEN coverage < 0.7 THEN 'topics_not_covered' END], lambda x: x IS NOT NULL) AS found FROM ro)
SELECT doc_id, word_count, content_depth, topical_relevance, round(coverage, 6) AS topic_coverage_ratio, coalesce(key_phrases, '') AS key_phrases, array_to_string(found, '|') AS relevance_issues, CASE WHEN word_count = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.25::DOUBLE * len(found)) END AS relevance_score FROM ri"""


def factorised(k: int = 3, rounds: int = 8) -> str:
    """Multiplicative updates, round by round."""
    seed = lambda c, j: f"(('0x' || md5({c}::VARCHAR || '#{j}')[1:6])::BIGINT + 1)::DOUBLE / 16777216"
    start = lambda name, c: f"{name}0 AS MATERIALIZED (SELECT {c}, {', '.join(f'{seed(c, j)} AS x{j}' for j in range(k))} FROM (SELECT DISTINCT {c} FROM e))"
    steps = [start("w", "doc_id"), start("h", "term")]

    def step(own: str, n: int, other: str, at: str, by: str) -> str:
        gram = ", ".join(f"sum(x{i} * x{j}) AS g{i}{j}" for i in range(k) for j in range(k))
        above = ", ".join(f"sum(value * x{j}) AS a{j}" for j in range(k))
        new = ", ".join(f"x{j} * a{j} / greatest({' + '.join(f'x{i} * g{i}{j}' for i in range(k))}, 1e-12) AS x{j}" for j in range(k))
        return f"{own}{n + 1} AS MATERIALIZED (SELECT {at}, {new} FROM {own}{n} JOIN (SELECT {at}, {above} FROM e JOIN {other} USING ({by}) GROUP BY 1) USING ({at}), (SELECT {gram} FROM {other}))"

    for n in range(rounds):
        steps += [step("w", n, f"h{n}", "doc_id", "term"), step("h", n, f"w{n + 1}", "term", "doc_id")]
    return ", ".join(steps)


TOPICS = f"""
, lg AS (SELECT doc_id, {_CONTENT} AS c FROM v WHERE len({_CONTENT}) >= 50),
tf0 AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(c) AS term FROM lg) GROUP BY 1, 2),
td AS (SELECT term, count(*) AS df FROM tf0 GROUP BY 1),
wt AS (SELECT doc_id, term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM lg)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS weight FROM tf0 JOIN td USING (term) WHERE df <= 0.95 * (SELECT count(*) FROM lg)),
e AS MATERIALIZED (SELECT doc_id, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS value FROM wt), {factorised()},
tz AS (SELECT {", ".join(f"sqrt(greatest(sum(x{j} * x{j}), 1e-12)) AS s{j}" for j in range(3))} FROM h8)"""
TOPIC_SHARES = TOPICS + """
, y AS (SELECT doc_id, [x0 * s0, x1 * s1, x2 * s2] AS x FROM w8, tz)
SELECT doc_id, round(x[1] * 100 / list_sum(x), 4) AS share_0, round(x[2] * 100 / list_sum(x), 4) AS share_1, round(x[3] * 100 / list_sum(x), 4) AS share_2, (list_position(x, list_max(x)) - 1)::INTEGER AS main_topic,
list_reverse_sort(x)[2] > 0 AND list_reverse_sort(x)[1] < 1.5 * list_reverse_sort(x)[2] AS unfocused FROM y"""
TOPIC_TERMS = TOPICS + """
, u AS (SELECT term, 0 AS topic, x0 / s0 AS weight FROM h8, tz UNION ALL SELECT term, 1, x1 / s1 FROM h8, tz UNION ALL SELECT term, 2, x2 / s2 FROM h8, tz)
SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term)::INTEGER AS rank, term, round(weight, 6) AS weight FROM u QUALIFY rank <= 10"""

_GRAMS = """t AS (SELECT doc_id, lang, trim(coalesce(text, '')) AS raw, regexp_replace(regexp_replace(' ' || lower(coalesce(text, '')) || ' ', '[^\\p{L}]+', ' ', 'g'), '^ $', '') AS s, substr(md5(doc_id::VARCHAR), 1, 1) IN ('0', '1', '2', '3') AS held_out FROM documents),
g AS (SELECT doc_id, lang, held_out, substr(s, i, 3) AS gram, count(*) AS n FROM (SELECT *, unnest(range(1, length(s) - 1)) AS i FROM t) GROUP BY ALL),
c AS (SELECT lang, gram, sum(n) AS n FROM g WHERE NOT held_out AND lang IS NOT NULL GROUP BY 1, 2),
p AS (SELECT lang, gram, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM c QUALIFY r <= 2000),
z AS (SELECT lang, sum(n) AS total FROM p GROUP BY 1), v AS (SELECT count(DISTINCT gram) AS size FROM p), k AS (SELECT DISTINCT gram FROM p),
m AS (SELECT k.gram, z.lang, ln((coalesce(p.n, 0) + 0.5::DOUBLE) / (total + 0.5::DOUBLE * size)) AS w FROM k CROSS JOIN z CROSS JOIN v LEFT JOIN p ON p.gram = k.gram AND p.lang = z.lang),
l AS (SELECT doc_id, m.lang AS found, round(sum(n * w), 6) AS likelihood FROM g JOIN m USING (gram) GROUP BY 1, 2),
b AS (SELECT doc_id, found FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY likelihood DESC, found) = 1),
y AS (SELECT t.doc_id, t.lang, held_out, CASE WHEN length(raw) < 10 THEN 'en' WHEN len(regexp_extract_all(raw, '[Ѐ-ӿ]')) * 2 > length(raw) THEN 'ru' ELSE coalesce(found, 'en') END AS detected_lang FROM t LEFT JOIN b USING (doc_id))"""
PROFILES = f"WITH {_GRAMS} SELECT * FROM y"
PROFILES_RIGHT = f"WITH {_GRAMS} SELECT lang, count(*) AS n, count(*) FILTER (lang = detected_lang) AS right FROM y WHERE held_out AND lang IS NOT NULL GROUP BY 1"

CRAWL = r"""
WITH RECURSIVE b AS (SELECT page_id, url, regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') AS t FROM pages),
a AS (SELECT url AS src, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site, unnest(regexp_extract_all(t, '<a href="([^"]*)"', 1)) AS href FROM b),
e AS (SELECT DISTINCT src, site || replace(replace(href, '&quot;', chr(34)), '&amp;', '&') AS dst FROM a WHERE href LIKE '/%'),
r AS (SELECT (SELECT url FROM pages ORDER BY page_id LIMIT 1) AS url, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.url WHERE r.depth < 3)
SELECT url, min(depth)::INTEGER AS depth FROM r WHERE url IS NOT NULL GROUP BY 1"""

CRAWL_PARTS = r"""
WITH RECURSIVE l AS (SELECT DISTINCT 'https://part.example/' || l_partkey AS a, 'https://supplier.example/' || l_suppkey AS b FROM lineitem),
e AS (SELECT a AS src, b AS dst FROM l WHERE NOT regexp_matches(b, '/[0-9]*13$') UNION ALL SELECT b, a FROM l WHERE NOT regexp_matches(a, '/[0-9]*13$')),
r AS (SELECT 'https://part.example/1' AS url, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.url WHERE r.depth < 4)
SELECT url, min(depth)::INTEGER AS depth FROM r GROUP BY 1"""

SEMANTIC_WHOLE = f"""
WITH kw AS ({TEXT + KEYWORDS}), en AS ({TEXT + ENTITIES}), co AS ({TEXT + COHERENCE}), tp AS ({TEXT + TOPIC_SHARES}), tx AS ({TEXT} SELECT doc_id, low FROM v),
kl AS (SELECT doc_id, list(term ORDER BY rank) AS ks FROM kw GROUP BY 1), el AS (SELECT doc_id, count(*) AS n FROM en GROUP BY 1),
a AS (SELECT doc_id, low, coalesce(ks, []) AS ks, greatest(100, len(low) // 5) AS size FROM tx LEFT JOIN kl USING (doc_id)),
p AS (SELECT doc_id, ks, low[k * size + 1 : (k + 1) * size] AS part FROM (SELECT *, unnest(range((len(low) + size - 1) // size)) AS k FROM a)),
d AS (SELECT doc_id, len(list_filter(part, lambda w: list_contains(ks[1:5], w))) * 100::DOUBLE / len(part) AS density FROM p),
s AS (SELECT doc_id, count(*) AS sections, min(density) AS least, max(density) AS most FROM d GROUP BY 1),
z AS (SELECT a.doc_id, ks, CASE WHEN len(low) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(low, lambda w: list_contains(ks[1:10], w))) * 100::DOUBLE / len(low) END AS overall, coalesce(sections, 0) AS sections, least, most, coalesce(el.n, 0) AS entities, coalesce(main_topic, -1)::INTEGER AS main_topic, unfocused, coherence
  FROM a LEFT JOIN s USING (doc_id) LEFT JOIN el USING (doc_id) LEFT JOIN tp USING (doc_id) JOIN co USING (doc_id)),
r AS (SELECT *, len(ks) > 0 AS known FROM z)
SELECT doc_id, array_to_string(ks[1:10], '|') AS keywords, round(overall, 6) AS overall_density, sections, round(least, 6) AS least, round(most, 6) AS most, entities, main_topic, coherence,
array_to_string(list_filter([CASE WHEN known AND overall < 1 THEN 'keywords_rare' END, CASE WHEN known AND overall > 5 THEN 'keywords_stuffed' END, CASE WHEN coherence < 0.2 THEN 'incoherent' END, CASE WHEN unfocused THEN 'unfocused' END,
CASE WHEN known AND sections > 1 AND most > 0 AND least < 0.3 * most THEN 'keywords_uneven' END, CASE WHEN entities = 0 THEN 'no_entities' END], lambda x: x IS NOT NULL), '|') AS codes FROM r"""

RECORDS = f"""
WITH sm AS ({SEMANTIC_WHOLE}), an AS ({ANALYSIS}), sf AS ({TEXT + STUFFED})
SELECT doc_id, 'completed' AS status, '2024-01-02 03:04' AS analyzed, coalesce(sf.stuffed, 0) > 0 AS stuffed, string_split(keywords, '|')[1] AS keyword, overall_density AS density, round(overall_readability, 6) AS readability, sentiment, main_topic, round(overall_quality, 6) AS quality
FROM sm JOIN an USING (doc_id) LEFT JOIN sf USING (doc_id)"""
