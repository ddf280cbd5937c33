"""URL filters by a sort-merge range join (DataFrame functions only).

A rule (host, path) becomes the key `reversed host labels # path` and stands for the interval of all keys that start with
it. A url has a key for its host and one for each domain above it. Intervals of such keys are nested or disjoint, so a
sweep over rules and url keys in order of their keys needs a stack only: the newest rule before a key with the rules
around it; what of that stack the key starts with is active there, and its last one is the longest.

Rules look at no more than their own labels and characters, so urls are first brought down to distinct sites (the top
labels that the longest rule host has) and cut paths. The sweep is cut into ranges of the sorted keys; a range starts
with the stack of the last rule before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, small, stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty where it is null or has no `://`."""
    part = lambda i: F.coalesce(F.regexp_extract(F.col(url).cast("string"), "://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def _site(host: str, labels: Column | int) -> Column:
    """The top labels of a host, top first."""
    return F.array_join(F.slice(F.reverse(F.split(host, "[.]")), F.lit(1), F.lit(labels) if isinstance(labels, int) else labels), ".")


def _rule_events(rules: DataFrame) -> DataFrame:
    """(key, stack): every rule's key with the rules around it, outermost first, itself last."""
    own = rules.withColumn("key", F.concat(_site("host", F.size(F.split("host", "[.]"))), F.lit("#"), "path"))
    size = (F.length("host") + F.length("path")).alias("size")
    mine = F.struct("key", size, F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict")
    own = own.groupBy("key").agg(F.min(mine).alias("me"))
    lengths = F.sequence(F.instr("key", "#"), F.length("key"))
    heads = own.select("key", F.explode(lengths).alias("n")).select(F.col("key").alias("inner"), F.expr("left(key, n)").alias("key"))
    around = heads.join(own, "key").groupBy("inner").agg(F.sort_array(F.collect_list("me")).alias("stack"))
    return around.withColumnRenamed("inner", "key")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """The rows of pages with host, path, rule (host and path of the rule that holds, else null) and verdict.

    rules: (host, path, verdict). A rule fits its host and all subdomains if the url's path starts with its own path (an
    empty one fits every path); the longest one holds, counted in characters of host and path, then of the host alone;
    of equal rules the verdict that sorts first. Rules without host fit nothing, a null path is an empty one. Null urls
    and those without `://` have an empty host and path and take the default verdict. Repeated rows stay, columns of
    pages named like a result are replaced. Empty tables: no rows, or the default everywhere.
    """
    rules = rules.select(
        F.translate(F.col("host").cast("string"), _UPPER, _LOWER).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), "verdict"
    ).where("host <> ''")
    labels, width = rules.agg(F.max(F.size(F.split("host", "[.]"))), F.max(F.length("path"))).first()
    host, path = host_and_path(url)
    rows = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    if labels is None:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    rows = rows.withColumns({"__site": _site("host", labels), "__cut": F.left("path", F.lit(width))})

    sites = rows.select("__site", "__cut").distinct()
    of_site = F.split("__site", "[.]")
    upper = F.transform(F.sequence(F.lit(1), F.size(of_site)), lambda i: F.array_join(F.slice(of_site, F.lit(1), i), "."))
    keys = sites.select(F.explode(upper).alias("domain"), "__site", "__cut")
    domains = rules.select(_site("host", labels).alias("domain")).distinct()
    keys = keys.join(small(domains), "domain", "left_semi").select(F.concat("domain", F.lit("#"), "__cut").alias("key"), "__site", "__cut")
    events = _rule_events(rules).withColumn("kind", F.lit(0)).unionByName(keys.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    events = events.withColumn("salt", F.xxhash64("__site", "__cut"))
    events = events.repartitionByRange("key", "kind", "salt").withColumn("range", F.spark_partition_id())
    events = stage(events, "url-events")

    # the sweep: one row a range for what stands open at its start, then each range on its own
    rule_key = F.when(F.col("kind") == 0, F.col("key"))
    opened = events.groupBy("range").agg(F.max_by("stack", rule_key).alias("newest"))
    before = F.last("newest", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    opened = opened.select("range", before.alias("before"))
    here = F.last("stack", ignorenulls=True).over(Window.partitionBy("range").orderBy("key", "kind", "salt"))
    swept = events.select("range", "key", "kind", "__site", "__cut", here.alias("here")).where("kind = 1").join(F.broadcast(opened), "range", "left")
    active = swept.withColumn("active", F.expr("filter(coalesce(here, before), s -> startswith(key, s.key))")).where("size(active) > 0")
    last = F.element_at("active", -1)
    best = F.max_by(last, F.struct(last["size"], last["host_size"])).alias("best")
    held = active.groupBy("__site", "__cut").agg(best).select("__site", "__cut", "best.rule", F.col("best.verdict").alias("verdict"))
    held = stage(held, "url-held")
    out = rows.join(small(held), ["__site", "__cut"], "left").drop("__site", "__cut")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged by RULES; a page of no rule is allowed."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(load(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP12_SQL = r"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fits AS (
  SELECT n, max_by(struct_pack(rule := rule_host || rule_path, verdict := verdict), length(rule_host) * 1000 + length(rule_path) * 1001) AS best
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM p LEFT JOIN fits USING (n)
"""
