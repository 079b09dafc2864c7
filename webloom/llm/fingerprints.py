"""Canonical exact digests of documents.

A text is made canonical (Unicode compatibility composition, full case folding, runs of white space to one
space, ends trimmed) and digested by two seeded xxhash64 values, 128 bits in all. Documents meet in the
bucket of their digest; within a bucket the canonical bytes themselves are compared, and texts that
differ in spite of equal digests get different ordinals. A fingerprint is `<digest>-<ordinal>`, so
fingerprints are equal exactly where canonical texts are, edited texts included. Only buckets with two members or more are
compared, by the least and greatest text of the bucket, which are aggregated before the shuffle: a group
of copies of any size costs one row for each map task.

The query exchanges the texts once, to bring each next to the one it is edited with; digests are taken there and written, and
what follows works on them. Only texts in shared buckets are made canonical again, to be compared.

Unicode normalisation and folding are calls of the ICU library that Spark itself ships, through the SQL
function reflect(); no Python runs on the executors.

Defined results: null text counts as empty; empty texts have equal fingerprints; likeness is 1 for equal
fingerprints, else 0; rows that repeat an id follow each other by their texts' hashes; in a table of one
row the next document is the row itself; an empty table gives an empty result. In fingerprint() extra columns pass through, but
for one of the output's name (in any case), which is replaced. Names that start with `_fp_` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, checkpoint, read, written

#: Digests that a broadcast may hold (40 bytes each).
MOST_BROADCAST = 1_000_000


def canonical(text: Column) -> Column:
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    folded = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    half = lambda *c: F.lpad(F.lower(F.hex(F.xxhash64(*c))), 16, "0")
    return F.concat(half(canon), half(F.lit("webloom"), canon))


def conflicts_of(members: DataFrame) -> DataFrame:
    """(_fp_d, _fp_c, _fp_n): an ordinal for each canonical text _fp_c of the buckets _fp_d whose members differ; normally no row."""
    odd = members.groupBy("_fp_d").agg(F.min("_fp_c").alias("lo"), F.max("_fp_c").alias("hi")).where("lo <> hi").select("_fp_d")
    odd = checkpoint(odd)
    if odd.isEmpty():
        return members.sparkSession.createDataFrame([], "_fp_d string, _fp_c string, _fp_n int")
    differing = members.join(odd, "_fp_d", "left_semi").select("_fp_d", "_fp_c").distinct()
    return checkpoint(differing.withColumn("_fp_n", F.row_number().over(Window.partitionBy("_fp_d").orderBy("_fp_c")) - 1))


def digest_conflicts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The conflicts among the texts of a column."""
    thin = checkpoint(df.select(canonical(F.col(text_col)).alias("_fp_c")).select(digest(F.col("_fp_c")).alias("_fp_d")).groupBy("_fp_d").count().where("count > 1").select("_fp_d"))
    shared = broadcast_if_small(thin, thin.count(), MOST_BROADCAST)
    own = df.select(canonical(F.col(text_col)).alias("_fp_c")).withColumn("_fp_d", digest(F.col("_fp_c"))).join(shared, "_fp_d", "left_semi")
    return conflicts_of(own)


def fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint", conflicts: DataFrame | None = None) -> DataFrame:
    """df with the fingerprint of text_col. conflicts: from digest_conflicts(), computed here if absent."""
    conflicts = digest_conflicts(df, text_col) if conflicts is None else conflicts
    tagged = df.withColumn("_fp_c", canonical(F.col(text_col))).withColumn("_fp_d", digest(F.col("_fp_c")))
    if conflicts.isEmpty():
        return tagged.withColumn(out, F.concat("_fp_d", F.lit("-0"))).drop("_fp_c", "_fp_d")
    tagged = tagged.join(conflicts, ["_fp_d", "_fp_c"], "left")
    return tagged.withColumn(out, F.concat("_fp_d", F.lit("-"), F.coalesce("_fp_n", F.lit(0)).cast("string"))).drop("_fp_c", "_fp_d", "_fp_n")


def next_by_descending_id(df: DataFrame, carry: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """df with columns of the next row in descending id order (after the last: the first).

    Ids are cut at quantiles, which are ids themselves, into buckets, found by binary search, and each bucket is a window of its
    own. The rows of the id that heads a bucket stand at the end of the bucket above too, as ghosts, so that the rows are
    exchanged once and nothing is joined. A repeated id is in one bucket."""
    buckets = buckets or min(4096, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    found = df.select(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 100_000), F.max(key)).first()
    if found[1] is None:
        return df.select("*", *[F.lit(None).alias(k) for k in carry])
    heads = sorted({*(found[0] or []), found[1]})
    levels = max(1, len(heads).bit_length())
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(levels))])
    at = F.array(*[F.lit(b).cast("long") for b in heads + [(1 << 63) - 1] * ((1 << levels) - len(heads))])
    bucket = F.aggregate(steps, F.lit(0), lambda lo, s: F.when(F.element_at(at, F.least(lo + s, F.lit(1 << levels))) < F.col("_fp_k"), lo + s).otherwise(lo))
    rows = df.withColumn("_fp_k", key).withColumn("_fp_b", bucket)
    # A head follows the last row of the bucket above its own; the greatest id follows the least.
    ghost = F.when(F.element_at(at, F.col("_fp_b") + 1) == F.col("_fp_k"), F.pmod(F.col("_fp_b") + 1, F.lit(len(heads))))
    stands = F.array(F.struct(F.col("_fp_b").alias("b"), F.lit(0).alias("g")), F.struct(ghost.alias("b"), F.lit(1).alias("g")))
    both = rows.withColumn("_fp_s", F.explode(F.filter(stands, lambda s: s["b"].isNotNull())))
    w = Window.partitionBy("_fp_s.b").orderBy("_fp_s.g", F.desc("_fp_k"), F.xxhash64(F.coalesce(text_col, F.lit(""))))
    both = both.select("*", *[c.alias(f"_fp_at_{k}") for k, c in carry.items()])
    return both.select(*[both[c] for c in df.columns], F.col("_fp_s.g").alias("_fp_g"), *[F.lead(f"_fp_at_{k}").over(w).alias(k) for k in carry]).where("_fp_g = 0").drop("_fp_g")


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as much of the following text's beginning."""
    text, following = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    cut = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(following, F.lit(1), cut))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("_fp_h", F.xxhash64("text"))
    rows = docs.withColumn("_fp_d", digest(canonical(F.col("text"))))
    rows = next_by_descending_id(rows, {"_fp_next": F.col("text"), "_fp_next_id": F.col("doc_id"), "_fp_next_h": F.col("_fp_h"), "_fp_next_d": F.col("_fp_d")})
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_fp_edit", edited(F.col("text"), F.col("_fp_next")))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("_fp_edit"), 256)).withColumn("_fp_e", digest(canonical(F.col("_fp_edit")))).drop("text", "_fp_next", "_fp_edit")
    rows = written(rows, "digests")

    shared = rows.select(F.explode(F.array("_fp_d", "_fp_e")).alias("_fp_d")).groupBy("_fp_d").count().where("count > 1").select("_fp_d")
    shared = checkpoint(shared)
    shared = broadcast_if_small(shared, shared.count(), MOST_BROADCAST)
    # Rows of one text need one look; their id and hash lead back to it.
    own = written(rows.join(shared, "_fp_d", "left_semi").select("doc_id", "_fp_h", "_fp_d").distinct(), "members")
    changed = rows.join(shared.withColumnRenamed("_fp_d", "_fp_e"), "_fp_e", "left_semi").select("doc_id", "_fp_h", "_fp_next_id", "_fp_next_h", F.col("_fp_e").alias("_fp_d")).distinct()
    changed = written(changed, "members")

    def with_text(members: DataFrame, key: str, h: str, out: str) -> DataFrame:
        wanted = broadcast_if_small(members.withColumnsRenamed({key: "_fp_id", h: "_fp_th"}), members.count(), MOST_BROADCAST)
        found = docs.select(F.col("doc_id").alias("_fp_i"), F.col("_fp_h").alias("_fp_x"), F.col("text").alias(out))
        return found.join(wanted, F.col("_fp_i").eqNullSafe(F.col("_fp_id")) & (F.col("_fp_x") == F.col("_fp_th"))).drop("_fp_i", "_fp_x").withColumnsRenamed({"_fp_id": key, "_fp_th": h})

    mine = with_text(own, "doc_id", "_fp_h", "text").select("doc_id", "_fp_h", "_fp_d", canonical(F.col("text")).alias("_fp_c"))
    others = with_text(changed, "doc_id", "_fp_h", "text")
    # Where the edit adds nothing of the next text, it is not needed.
    others = with_text(others, "_fp_next_id", "_fp_next_h", "_fp_next").select("doc_id", "_fp_h", "_fp_next_id", "_fp_next_h", "_fp_d", canonical(edited(F.col("text"), F.col("_fp_next"))).alias("_fp_c"))
    conflicts = conflicts_of(mine.select("_fp_d", "_fp_c").union(others.select("_fp_d", "_fp_c")))
    nth, nth_next, nth_edit = F.lit(0), F.lit(0), F.lit(0)
    if not conflicts.isEmpty():
        ordinal = lambda members: members.join(conflicts, ["_fp_d", "_fp_c"]).drop("_fp_c", "_fp_d").distinct()
        mine, others = checkpoint(ordinal(mine)), checkpoint(ordinal(others))

        def looked_up(rows: DataFrame, found: DataFrame, keys: dict[str, str], out: str) -> DataFrame:
            found = found.withColumnsRenamed({k: f"_fp_key_{k}" for k in keys} | {"_fp_n": out})
            same = [F.col(v).eqNullSafe(F.col(f"_fp_key_{k}")) for k, v in keys.items()]
            return rows.join(found, same, "left").drop(*[f"_fp_key_{k}" for k in keys])

        rows = looked_up(rows, mine, {"doc_id": "doc_id", "_fp_h": "_fp_h"}, "_fp_n1")
        rows = looked_up(rows, mine, {"doc_id": "_fp_next_id", "_fp_h": "_fp_next_h"}, "_fp_n2")
        rows = looked_up(rows, others, {k: k for k in ("doc_id", "_fp_h", "_fp_next_id", "_fp_next_h")}, "_fp_n3")
        nth, nth_next, nth_edit = (F.coalesce(c, F.lit(0)) for c in ("_fp_n1", "_fp_n2", "_fp_n3"))
    mark = lambda d, n: F.concat(F.col(d), F.lit("-"), n.cast("string"))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", mark("_fp_d", nth).alias("fingerprint"), mark("_fp_e", nth_edit).alias("edited_fingerprint"), mark("_fp_next_d", nth_next).alias("_fp_next"))
    alike = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return rows.select("*", alike("edited_fingerprint").alias("near_edited"), alike("_fp_next").alias("near_next")).drop("_fp_next")


def op6_canonical_digest(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read(spark, sf_dir, "documents"))
