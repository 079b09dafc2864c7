"""Mixing sources to target weights by Pareto order sampling.

The corpus holds T words. Sources, ordered by code point with null last, weigh 5, 2, 1 repeating and
share T in proportion; no target passes `most` (3) times what its source has, and what is cut off is
shared anew by weight (water filling, solved in closed form over the sources sorted by their caps).

A source with target t and s words gives every document floor(t / s) certain copies. What is then
missing, R words, comes from one Pareto order sample. The inclusion probability of a document is in proportion
to its size, p_i = min(1, c * size_i), with c such that the sample's words, the sum of p_i * size_i, are
R on average (larger documents are likelier: the words are the size measure). A document draws u_i and is
ranked by (u_i / (1 - u_i)) / (p_i / (1 - p_i)); one with p_i = 1 comes first. Documents join in that order while
their words fit into R. One closing document, the one left over whose size comes nearest to what is
still missing, joins if that brings the source nearer to its target.

The ranks are first summed in buckets, so only one bucket of each source is ever put in order; no task
holds a source. u_i comes from a digest of the id: reruns agree, on any cluster.

Defined results: null text has size 0; documents without words are never drawn but keep their certain
copies (taking 0 words); rows that repeat an id rank alike and join or stay together; an empty table
gives an empty result; sources without words have target 0. Extra columns pass through, but for
those of the output's names, which are replaced; names that start with `_mix_` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, checkpoint, n_words, read

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKETS = 4096


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that only the id and the seed decide; the same in any SQL engine with md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("z"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each source (_mix_key, source_size): its target. Works on as many rows as sources."""
    by_name, everything = Window.orderBy("_mix_key"), Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    before = Window.orderBy("_mix_ratio", "_mix_key").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("_mix_ratio", "_mix_key").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double") / F.sum("_mix_weight").over(after)
    return (
        sizes.withColumn("_mix_weight", weight)
        .withColumn("_mix_ratio", (most * F.col("source_size")).cast("double") / F.col("_mix_weight"))
        .withColumn("_mix_level", level)
        .withColumn("target", F.least((most * F.col("source_size")).cast("double"), F.max("_mix_level").over(everything) * F.col("_mix_weight")))
    )


def pareto_rank(u: Column, p: Column) -> Column:
    """Random odds by inclusion odds; 0 where the inclusion is certain."""
    return F.when(p >= 1.0, 0.0).otherwise((u / (1.0 - u)) / (p / (1.0 - p)))


def inclusion_rates(thin: DataFrame, plan: DataFrame) -> DataFrame:
    """(_mix_key, _mix_rate): the c of each source for which min(1, c * size) * size sums up to what it lacks.

    Worked out over the source's distinct sizes: with all sizes up to one of them below certainty and the larger ones
    certain, c follows; the largest size for which that c leaves it at 1 or below is the one that holds."""
    sizes = thin.where("_mix_size > 0").groupBy("_mix_key", "_mix_size").agg(F.count(F.lit(1)).alias("n")).join(plan.select("_mix_key", "_mix_rest"), "_mix_key")
    whole = lambda c: c.cast("decimal(38,0)")
    upto, after = Window.partitionBy("_mix_key").orderBy("_mix_size"), Window.partitionBy("_mix_key").orderBy(F.desc("_mix_size")).rowsBetween(Window.unboundedPreceding, -1)
    squares = F.sum(whole(F.col("n")) * whole(F.col("_mix_size") * F.col("_mix_size"))).over(upto).cast("double")
    certain = F.coalesce(F.sum(F.col("n") * F.col("_mix_size")).over(after), F.lit(0)).cast("double")
    sizes = sizes.withColumn("_mix_rate", (F.col("_mix_rest") - certain) / squares)
    return sizes.where(F.col("_mix_rate") * F.col("_mix_size") <= 1.0).groupBy("_mix_key").agg(F.max_by("_mix_rate", "_mix_size").alias("_mix_rate"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights=WEIGHTS, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """df with size, source_size, target and copies: how often the mix takes each document."""
    df = df.drop("size", "source_size", "target", "copies")
    u = uniform(F.col("_mix_id"), seed)
    thin = checkpoint(
        df.select(F.col(id_col).alias("_mix_id"), _key(F.col(source_col)).alias("_mix_key"), n_words(F.col(text_col)).alias("_mix_size"))
    )
    sizes = thin.groupBy("_mix_key").agg(F.sum("_mix_size").alias("source_size"))
    plan = source_targets(sizes, weights, most)
    whole = F.when(F.col("source_size") == 0, 0.0).otherwise(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("double"))
    plan = plan.withColumn("_mix_whole", whole).withColumn("_mix_rest", F.col("target") - F.col("_mix_whole") * F.col("source_size"))
    plan = checkpoint(plan.select("_mix_key", "source_size", "target", "_mix_whole", "_mix_rest"))
    n_sources = plan.count()
    plan = broadcast_if_small(plan, n_sources)
    plan = broadcast_if_small(checkpoint(plan.join(inclusion_rates(thin, plan), "_mix_key", "left")), n_sources)

    rank = F.when((F.col("_mix_size") > 0) & (F.col("_mix_rest") > 0), pareto_rank(u, F.col("_mix_rate") * F.col("_mix_size")))
    ranked = thin.join(plan, "_mix_key").withColumn("_mix_rank", rank).where("_mix_rank IS NOT NULL")
    ranked = ranked.withColumn("_mix_bucket", F.floor(F.col("_mix_rank") / (1.0 + F.col("_mix_rank")) * buckets))
    so_far = Window.partitionBy("_mix_key").orderBy("_mix_bucket")
    sums = ranked.groupBy("_mix_key", "_mix_bucket").agg(F.sum("_mix_size").alias("_mix_in"), F.first("_mix_rest").alias("_mix_rest"))
    sums = sums.withColumn("_mix_to", F.sum("_mix_in").over(so_far)).where(F.col("_mix_to") >= F.col("_mix_rest"))
    edge = sums.groupBy("_mix_key").agg(F.min(F.struct("_mix_bucket", (F.col("_mix_to") - F.col("_mix_in")).alias("below"))).alias("e"))
    edge = broadcast_if_small(edge.select("_mix_key", F.col("e._mix_bucket").alias("_mix_bucket"), F.col("e.below").alias("_mix_below")), n_sources)
    near = ranked.join(edge, ["_mix_key", "_mix_bucket"])
    run = Window.partitionBy("_mix_key").orderBy("_mix_rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("_mix_sum", F.col("_mix_below") + F.sum("_mix_size").over(run))
    last = near.where(F.col("_mix_sum") <= F.col("_mix_rest")).groupBy("_mix_key").agg(F.max("_mix_rank").alias("_mix_cut"), F.max("_mix_sum").alias("_mix_got"))
    cuts = plan.join(broadcast_if_small(edge, n_sources), "_mix_key", "left").join(broadcast_if_small(last, n_sources), "_mix_key", "left")
    cuts = cuts.withColumn("_mix_lacks", F.col("_mix_rest") - F.coalesce("_mix_got", "_mix_below"))
    cuts = broadcast_if_small(checkpoint(cuts), n_sources)
    rest = ranked.join(cuts.select("_mix_key", F.col("_mix_bucket").alias("_mix_b"), "_mix_cut", "_mix_lacks"), "_mix_key")
    rest = rest.where((F.col("_mix_bucket") > F.col("_mix_b")) | (F.col("_mix_bucket") == F.col("_mix_b")) & F.coalesce(F.col("_mix_rank") > F.col("_mix_cut"), F.lit(True)))
    off = F.abs(F.col("_mix_size") - F.col("_mix_lacks"))
    close = rest.where(off < F.col("_mix_lacks")).groupBy("_mix_key").agg(F.min(F.struct(off.alias("off"), F.col("_mix_rank").alias("rank"))).alias("c"))
    close = close.select("_mix_key", F.col("c.rank").alias("_mix_last"))
    cuts = broadcast_if_small(checkpoint(cuts.join(broadcast_if_small(close, n_sources), "_mix_key", "left")), n_sources)

    out = df.withColumn("_mix_key", _key(F.col(source_col))).withColumn("_mix_size", n_words(F.col(text_col)))
    names = {"source_size": "_mix_s", "target": "_mix_target"}
    out = out.join(cuts.withColumnsRenamed(names), "_mix_key", "left").withColumn("_mix_u", uniform(F.col(id_col), seed))
    rank = F.when((F.col("_mix_size") > 0) & (F.col("_mix_rest") > 0), pareto_rank(F.col("_mix_u"), F.col("_mix_rate") * F.col("_mix_size")))
    bucket = F.floor(F.col("_mix_r") / (1.0 + F.col("_mix_r")) * buckets)
    drawn = F.col("_mix_r").isNotNull() & (
        (bucket < F.col("_mix_bucket")) | F.coalesce(F.col("_mix_r") <= F.col("_mix_cut"), F.lit(False)) | F.coalesce(F.col("_mix_r") == F.col("_mix_last"), F.lit(False))
    )
    out = out.withColumn("_mix_r", rank).withColumn("_mix_copies", (F.col("_mix_whole") + drawn.cast("int")).cast("int"))
    return out.select(*[df[c] for c in df.columns], F.col("_mix_size").alias("size"), F.col("_mix_s").alias("source_size"), F.col("_mix_target").alias("target"), F.col("_mix_copies").alias("copies"))


def op9_pareto_mix(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix_sources(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'z') AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS s FROM d GROUP BY k),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
r AS (SELECT *, (3 * s)::DOUBLE / w AS ratio FROM w),
l AS (SELECT *, ((sum(s) OVER () - 3 * coalesce(sum(s) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE)
                / sum(w) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT k, s, least((3 * s)::DOUBLE, max(level) OVER () * w) AS target FROM l),
p AS (SELECT *, CASE WHEN s = 0 THEN 0.0::DOUBLE ELSE floor(target / s::DOUBLE) END AS whole FROM t),
q AS (SELECT *, target - whole * s AS rest FROM p),
h AS (SELECT d.k, d.size, count(*) AS n FROM d WHERE size > 0 GROUP BY 1, 2),
c AS (
  SELECT h.k, h.size, (rest - coalesce(sum(n * h.size) OVER (PARTITION BY h.k ORDER BY h.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(n::HUGEINT * (h.size * h.size)::HUGEINT) OVER (PARTITION BY h.k ORDER BY h.size))::DOUBLE AS rate
  FROM h JOIN q ON h.k = q.k),
o AS (SELECT q.*, e.rate FROM q LEFT JOIN (SELECT k, arg_max(rate, size) AS rate FROM c WHERE rate * size <= 1.0::DOUBLE GROUP BY k) e ON q.k = e.k),
ranked AS (
  SELECT d.*, o.s, o.target, o.whole, o.rest,
         CASE WHEN size > 0 AND rest > 0 THEN
              CASE WHEN rate * size >= 1.0::DOUBLE THEN 0.0::DOUBLE ELSE (u / (1.0::DOUBLE - u)) / ((rate * size) / (1.0::DOUBLE - rate * size)) END END AS rk
  FROM d JOIN o ON d.k = o.k),
m AS (SELECT *, sum(CASE WHEN rk IS NOT NULL THEN size END) OVER (PARTITION BY k, rk IS NULL ORDER BY rk) AS upto FROM ranked),
g AS (SELECT k, any_value(rest) - coalesce(max(CASE WHEN rk IS NOT NULL AND upto <= rest THEN upto END), 0) AS lacks FROM m GROUP BY k),
z AS (SELECT k, arg_min(rk, {'a': abs(size - lacks), 'b': rk}) AS closing FROM m JOIN g USING (k)
      WHERE rk IS NOT NULL AND upto > rest AND abs(size - lacks) < lacks GROUP BY k),
f AS (SELECT m.*, (whole + CASE WHEN rk IS NOT NULL AND (upto <= rest OR coalesce(rk = closing, false)) THEN 1 ELSE 0 END)::INTEGER AS copies FROM m LEFT JOIN z USING (k))
SELECT doc_id, size, s AS source_size, target, (copies * size)::BIGINT AS taken, copies, source FROM f
"""
