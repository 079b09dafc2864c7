"""robots.txt rules over many hosts: parse the files once into rules, then judge links by a join on the host.

Kept as the rules are commonly applied here: everything in a file is lower-cased, rules for an agent replace those
for all agents, any allow match wins over disallow, `*` is a wildcard, and a missing file or path allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rules(files: DataFrame, host_col: str = "host", text_col: str = "content") -> DataFrame:
    """(host, agent, kind, path): each allow and disallow line with each agent of its section."""
    line = F.trim(F.regexp_replace(F.col("raw"), "#.*$", ""))
    lines = files.select(F.col(host_col).alias("host"), F.posexplode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\r?\n")).alias("n", "raw")).withColumn("line", line).where("line <> ''")
    lines = lines.select("host", "n", F.trim(F.regexp_extract("line", r"^([a-z-]+)\s*:", 1)).alias("field"), F.trim(F.regexp_extract("line", r"^[a-z-]+\s*:\s*(.*)$", 1)).alias("value"))
    per = lines.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("n", "field", "value"))).alias("ls"))
    # One pass over a file: a user-agent line after a rule opens a new section.
    state = "struct<agents:array<string>,open:boolean,out:array<struct<agents:array<string>,kind:string,path:string>>>"
    start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(True).alias("open"), F.array().cast("array<struct<agents:array<string>,kind:string,path:string>>").alias("out")).cast(state)
    agent = lambda s, x: F.struct(F.when(s["open"], F.concat(s["agents"], F.array(x["value"]))).otherwise(F.array(x["value"])).alias("agents"), F.lit(True).alias("open"), s["out"].alias("out"))
    rule = lambda s, x: F.struct(s["agents"].alias("agents"), F.lit(False).alias("open"), F.concat(s["out"], F.array(F.struct(s["agents"].alias("agents"), x["field"].alias("kind"), x["value"].alias("path")))).alias("out"))
    fold = F.aggregate("ls", start, lambda s, x: F.when(x["field"] == "user-agent", agent(s, x)).when(x["field"].isin("allow", "disallow") & (F.size(s["agents"]) > 0), rule(s, x)).otherwise(s).cast(state))
    found = per.select("host", F.explode(fold["out"]).alias("r")).select("host", F.explode("r.agents").alias("agent"), "r.kind", "r.path")
    return found.where("path <> ''")


def matches(path: Column, rule: Column) -> Column:
    """Exact, by wildcard from the beginning, or by prefix."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(rule, r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*"))
    return F.when(F.contains(rule, F.lit("*")), F.regexp_like(path, pattern)).otherwise((path == rule) | F.startswith(path, rule))


def allowed(urls: DataFrame, found: DataFrame, agent: str, url_col: str = "url") -> DataFrame:
    """urls with allowed: whether their host's rules let the agent fetch them. Rules join by host, skew is left to AQE."""
    host = F.lower(F.coalesce(F.expr(f"try_parse_url(`{url_col}`, 'HOST')"), F.lit("")))
    path = F.coalesce(F.nullif(F.expr(f"try_parse_url(`{url_col}`, 'PATH')"), F.lit("")), F.lit("/"))
    own = found.where((F.col("agent") != "*") & F.contains(F.lit(agent.lower()), F.col("agent")))
    named = own.select("host").distinct()
    use = own.unionByName(found.where(F.col("agent") == "*").join(named, "host", "left_anti"))
    per = use.groupBy("host").agg(F.collect_set(F.when(F.col("kind") == "allow", F.col("path"))).alias("allows"), F.collect_set(F.when(F.col("kind") == "disallow", F.col("path"))).alias("denies"))
    out = urls.withColumn("rb_host_", host).withColumn("rb_path_", path).join(per.withColumnRenamed("host", "rb_host_"), "rb_host_", "left")
    some = lambda c: F.coalesce(F.exists(c, lambda r: matches(F.col("rb_path_"), r)), F.lit(False))
    return out.withColumn("allowed", some("allows") | ~some("denies")).select(*urls.columns, "allowed")
