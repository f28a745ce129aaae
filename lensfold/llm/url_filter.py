"""URL rules by a sort-merge range join; DataFrame operations only.

The canonical key of a host is its labels from the last to the first, each with a dot after it, so a rule on a host covers
the interval of keys that begin with its own. Interval ends and urls are sorted together and dealt out by ranges; a sweep
over each range keeps the stack of rules whose interval is open. The stack changes at interval ends only and is known there
from the rules alone: rules nest, so it is the rule's own and those of its shorter keys. What is open where a range begins
is carried over from the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lensfold.llm.common import save

#: (verdict, host, path); fixed values of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STACK = "array<struct<host:string,path:string,verdict:string>>"


def rules_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    rows = F.array(*[F.struct(*map(F.lit, rule)) for rule in rules]).cast("array<struct<verdict:string,host:string,path:string>>")
    return spark.range(1).select(F.inline(rows))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no ``://``."""
    whole = F.coalesce(url, F.lit(""))
    rest = F.when(F.locate("://", whole) > 0, F.substr(whole, F.locate("://", whole) + F.lit(3), F.char_length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substr(rest, F.char_length(host) + F.lit(1), F.char_length(rest) + F.lit(1)), r"^[^?#]*", 0)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def boundaries(rules: DataFrame) -> DataFrame:
    """``key, stack``: where an interval begins or ends, and the rules that are open from there on."""
    rules = rules.filter("host is not null and host <> ''").select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    own = rules.withColumn("key", host_key(F.col("host")))
    labels = F.split("key", r"\.")
    # "net.example." has the shorter keys "net." and itself.
    keys = own.select("key").distinct().withColumn("n", F.size(labels) - 1)
    opened = keys.select("key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"), "n", labels.alias("labels")).select("key", (F.col("k") == F.col("n")).alias("itself"), F.concat(F.array_join(F.slice("labels", 1, F.col("k")), "."), F.lit(".")).alias("of"))
    held = opened.join(own.select(F.col("key").alias("of"), F.struct("host", "path", "verdict").alias("rule")), "of")
    both = held.groupBy("key").agg(F.collect_list("rule").alias("inner"), F.collect_list(F.when(~F.col("itself"), F.col("rule"))).alias("outer"))
    end = F.concat(F.expr("substr(key, 1, char_length(key) - 1)"), F.lit("/"))  # "/" follows "." in byte order
    return both.select(F.explode(F.array(F.struct("key", F.col("inner").alias("stack")), F.struct(end.alias("key"), F.col("outer").alias("stack")))).alias("b")).select("b.*")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages(page_id, url)``.

    A rule fits its host and that host's subdomains if the path begins with the rule's path. The longest rule wins (host
    and path together; then the longer host; then ``block``). A url that no rule fits, a null one and one without ``://``
    get ``default`` and a null rule. Repeated rows are judged each; null ids pass through; an empty table or no rules
    work alike. Rows with equal keys are split over ranges by path and id, so a host with most of the urls is spread.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host"))).withColumn("is_url", F.lit(True)).withColumn("stack", F.lit(None).cast(_STACK))
    ends = boundaries(rules).select(F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit("").alias("path"), "key", F.lit(False).alias("is_url"), "stack")
    order = ["key", "is_url", "path", "page_id"]
    dealt = save(urls.unionByName(ends).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    # One row for each range: what is open at its end, then what was open at the end of those before it.
    closing = dealt.groupBy("part").agg(F.max_by(F.when(~F.col("is_url"), F.col("stack")), F.when(~F.col("is_url"), F.col("key"))).alias("closing"))
    opening = closing.select("part", F.last("closing", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("opening"))
    sweep = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).filter("is_url")
    swept = swept.join(opening, "part").withColumn("open", F.coalesce("open", "opening", F.expr("array()").cast(_STACK)))
    fits = F.filter("open", lambda r: F.col("path").startswith(r["path"]))
    ranked = F.transform(fits, lambda r: F.struct((F.char_length(r["host"]) + F.char_length(r["path"])).alias("a"), F.char_length(r["host"]).alias("b"), r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule")))
    best = F.array_max(ranked)
    return swept.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def filter_pages(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """The ``page_id`` of pages whose url is allowed, with the verdict's columns."""
    return judge_urls(pages, rules, default).filter("verdict = 'allow'")


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h0, rest FROM u
), p AS (
  SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path
  FROM h
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fit AS (
  SELECT p.*, r.verdict, rhost || rpath AS rule,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) + length(rpath) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1
"""
