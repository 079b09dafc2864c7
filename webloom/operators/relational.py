"""The table operations: lookups, pages of results, patches, cascades, ownership, status steps, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.sinks import checkpointed


def get(df: DataFrame, key: str, value) -> DataFrame:
    """Rows of one key: at most one for a primary key."""
    return df.where(F.col(key) == value).limit(1)


def get_multi(df: DataFrame, order: list[str], skip: int = 0, limit: int = 100) -> DataFrame:
    """One page of results, in a fixed order."""
    return df.orderBy(*order).offset(skip).limit(limit)


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def update(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """base with the patch's columns where the patch has the key, nulls included; other columns stay."""
    given = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"p_{c}") for c in given], F.lit(True).alias("p_given"))
    out = base.join(p, key, "left")
    return out.select(*[F.when(F.col("p_given"), F.col(f"p_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in base.columns])


def remove_cascade(parents: DataFrame, key: str, gone: DataFrame, *children: tuple[DataFrame, str, str]) -> list[DataFrame]:
    """What is left of parents and of each chain of children (frame, foreign key, own key) after gone's keys go."""
    out, lost = [parents.join(gone.select(key), key, "left_anti")], gone.select(key)
    last = key
    for child, foreign, own in children:
        keys = lost.select(F.col(last).alias(foreign))
        out.append(child.join(keys, foreign, "left_anti"))
        lost, last = child.join(keys, foreign, "left_semi").select(own), own
    return out


def owned(pages: DataFrame, projects: DataFrame, user_id, superuser: bool = False, project_key: str = "project_id", owner: str = "user_id") -> DataFrame:
    """Pages whose project belongs to the user; all for a superuser."""
    return pages if superuser else pages.join(projects.where(F.col(owner) == user_id).select(project_key), project_key, "left_semi")


PAGE_STEPS = {"pending": ["parsing"], "parsing": ["analyzed", "error"], "analyzed": ["optimized", "parsing"], "error": ["parsing"], "optimized": ["parsing"]}


def step(status: Column, wanted: Column, steps: dict[str, list[str]] = PAGE_STEPS) -> Column:
    """The wanted status where the step is allowed, else the old one."""
    out = status
    for a, bs in steps.items():
        out = F.when((status == a) & wanted.isin(*bs), wanted).otherwise(out)
    return out


def recommendations(found: DataFrame) -> DataFrame:
    """One shape for records of either form: category mapped (unknown: content), priority 3 if none, title from text."""
    kinds = {"readability": "content", "vocabulary": "content", "structure": "structure", "sentiment": "content", "emotion": "content", "cta": "conversion", "ux": "ux", "seo": "seo"}
    cat = F.coalesce(*[F.when(F.col("category") == a, F.lit(b)) for a, b in kinds.items()], F.lit("content"))
    return found.withColumn("category", cat).withColumn("priority", F.coalesce("priority", F.lit(3)))


def live(cache: DataFrame, now: Column, ttl_seconds: int = 3600, at: str = "ts") -> DataFrame:
    """Entries that have not outlived their time, to the microsecond."""
    return cache.where(F.unix_micros(now) - F.unix_micros(F.col(at).cast("timestamp")) <= ttl_seconds * 1_000_000)


def evict(cache: DataFrame, most: int = 1000, keep: int = 800, at: str = "ts", key: str = "key") -> DataFrame:
    """Over `most` entries the newest `keep`; the limit is the feature, and the sort keeps only that many a task."""
    return cache.orderBy(F.desc(at), key).limit(keep) if cache.count() > most else cache


def cache_key(url: Column, text: Column) -> Column:
    return F.when(url.isNotNull(), F.concat(F.lit("url_"), F.md5(url.cast("binary")))).otherwise(F.concat(F.lit("text_"), F.md5(F.substring(F.coalesce(text, F.lit("")), 1, 1000).cast("binary"))))


def latest(df: DataFrame, keys: list[str], at: str, *ties: str) -> DataFrame:
    """Of each key the newest row."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), *ties)
    return df.withColumn("rl_r_", F.row_number().over(w)).where("rl_r_ = 1").drop("rl_r_")


def new_only(candidates: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose keys are not known yet, one of each."""
    return candidates.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti")


def mark_implemented(found: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """The flag set on the rows named; it never goes back."""
    done = F.coalesce(F.col("is_implemented"), F.lit(False)) if "is_implemented" in found.columns else F.lit(False)
    return found.withColumn("is_implemented", done | F.col(key).isin(*ids) if ids else done)


def by_priority(found: DataFrame, key: str, value, category: str | None = None, tie: str = "id") -> DataFrame:
    """Recommendations of one analysis, of one category if given, the most urgent first."""
    rows = found.where(F.col(key) == value)
    return (rows.where(F.col("category") == category) if category else rows).orderBy("priority", tie)


def follow(links: DataFrame, k: int = 10) -> DataFrame:
    """Of each page the first k internal links (the limit is the feature), each once."""
    each = links.where("internal").groupBy("page_id", "url").agg(F.min("pre").alias("pre"))
    return each.withColumn("rl_r_", F.row_number().over(Window.partitionBy("page_id").orderBy("pre"))).where(F.col("rl_r_") <= k).drop("rl_r_")


def fetch_outcome(status: Column, tries: Column, most: int = 3) -> Column:
    """ok, missing (403, 404), wait (429), retry (500 and more while tries are left), failed."""
    return F.when(status == 200, "ok").when(status.isin(403, 404), "missing").when((status == 429) & (tries < most), "wait").when((status >= 500) & (tries < most), "retry").otherwise("failed")


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """df and the new rows; columns that the rows lack are null."""
    return df.unionByName(rows, allowMissingColumns=True)


def of_parent(df: DataFrame, key: str, value, order: list[str], skip: int = 0, limit: int = 100) -> DataFrame:
    """One page of the rows of a parent."""
    return get_multi(df.where(F.col(key) == value), order, skip, limit)


def with_one(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """df with the one row that other holds for its key, if any: a page with its analysis."""
    return df.join(other, key, "left")


def is_empty(df: DataFrame) -> DataFrame:
    """One row that says whether there is none; one row of df is looked at."""
    return df.limit(1).agg((F.count(F.lit(1)) == 0).alias("empty"))


def replace_children(df: DataFrame, key: str, new: DataFrame) -> DataFrame:
    """Deletes the rows of every key that new holds, then inserts new: how recommendations of an analysis are stored."""
    return df.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def stored_recommendations(found: DataFrame) -> DataFrame:
    """Records as stored: the title is the text if there is none, the suggestion the description, the priority 3 by default."""
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("text"))
    return recommendations(found).withColumns({"title": title, "suggestion": F.col("description"), "description": F.coalesce("text", F.lit(""))})


def parse_outcome(df: DataFrame, error: str = "error") -> DataFrame:
    """Status and payload of parsed pages: analyzed, or error with its message."""
    failed = F.col(error).isNotNull()
    return df.withColumns({"status": F.when(failed, "error").otherwise("analyzed"), "payload": F.when(failed, F.to_json(F.struct(F.col(error).alias("message"))))})


def batch(results: DataFrame, key: str = "url", error: str = "error") -> DataFrame:
    """One row for each url: of repeated ones the first without an error, by result."""
    w = Window.partitionBy(key).orderBy(F.col(error).isNotNull(), *[c for c in results.columns if c not in (key, error)])
    return results.withColumn("rl_r_", F.row_number().over(w)).where("rl_r_ = 1").drop("rl_r_")


#: Which columns of a result each option asks for.
OPTIONS = {"include_html": ["html"], "include_text": ["text"], "include_metadata": ["title", "description"], "include_structure": ["structure"], "include_links": ["links"]}


def projected(df: DataFrame, options: dict[str, bool], always: tuple[str, ...] = ("url",)) -> DataFrame:
    """The columns that the options ask for, as far as the result has them."""
    wanted = [*always, *(c for k, cs in OPTIONS.items() if options.get(k) for c in cs)]
    return df.select(*[c for c in wanted if c in df.columns])


def counters(df: DataFrame, status: str = "status") -> DataFrame:
    """Totals of a session: pages, successes, failures, share of successes."""
    ok = F.count_if(F.col(status) != "error")
    return df.agg(F.count(F.lit(1)).alias("pages"), ok.alias("done"), F.count_if(F.col(status) == "error").alias("failed"), F.when(F.count(F.lit(1)) > 0, ok / F.count(F.lit(1))).otherwise(0.0).alias("done_share"))


def cache_put(cache: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """The cache with the rows' entries, which take the place of older ones."""
    return cache.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def cache_get(cache: DataFrame, keys: DataFrame, now: Column, ttl_seconds: int = 3600, at: str = "ts", key: str = "key") -> DataFrame:
    """keys with what lives in the cache; null for a miss."""
    return keys.join(live(cache, now, ttl_seconds, at), key, "left")


def cache_drop(cache: DataFrame, keys: DataFrame | None = None, key: str = "key") -> DataFrame:
    """The cache without some keys, or empty."""
    return cache.limit(0) if keys is None else cache.join(keys.select(key).distinct(), key, "left_anti")


def evict_expired_first(cache: DataFrame, now: Column, most: int = 1000, keep: int = 800, ttl_seconds: int = 3600, at: str = "ts", key: str = "key") -> DataFrame:
    """Over `most` entries the expired ones go, then the newest `keep` stay."""
    return evict(live(cache, now, ttl_seconds, at), most, keep, at, key) if cache.count() > most else cache


#: What stands for a page that is yet to be generated.
PLACEHOLDER = {"html": "<html><body><h1>Optimized Content</h1></body></html>", "css": "body { font-family: Arial, sans-serif; }", "diff": "{}"}


def optimized_placeholder(pages: DataFrame) -> DataFrame:
    return pages.withColumns({k: F.lit(v) for k, v in PLACEHOLDER.items()})


def sitemap_urls(files: DataFrame, start: str, most: int = 100, depth: int = 5) -> DataFrame:
    """(url, depth) of the pages that a sitemap names, index files followed: files (loc, urls, child_sitemaps) of readers.sitemap.
    At most `most` pages (a limit of the caller's), by depth and url. Each round is checkpointed."""
    spark = files.sparkSession
    frontier = seen = spark.createDataFrame([(start,)], "loc string")
    found = spark.createDataFrame([], "url string, depth int")
    for n in range(depth):
        here = files.join(frontier, "loc", "left_semi")
        found = checkpointed(found.unionByName(here.select(F.explode("urls").alias("url"), F.lit(n).alias("depth"))))
        frontier = checkpointed(here.select(F.explode("child_sitemaps").alias("loc")).distinct().join(seen, "loc", "left_anti"))
        if frontier.isEmpty():
            break
        seen = checkpointed(seen.unionByName(frontier))
    return found.groupBy("url").agg(F.min("depth").alias("depth")).orderBy("depth", "url").limit(most)
