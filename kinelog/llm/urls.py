"""URL filter with redirect equivalence, in DataFrame operations only.

Rules (host, path, verdict) decide the urls they fit; the longest wins. Urls that are the same page by another name
are aliases: a page and the target of its canonical link or meta refresh, and urls that differ only in scheme,
fragment, tracking parameters, a closing slash or a file ending. Connected components over those edges carry block
decisions to aliases without a rule. An explicit allow anywhere in the component takes precedence over its blocks; a
url's own rule comes before both. Without any decision a url is allowed.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, no alias and is allowed;
null html has no links; links that are neither absolute nor rooted are not followed; repeated rows and null page_ids are
judged row by row; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Fixed patterns; both engines read them alike.
HOST_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^[^?#]*\?([^#]*)"
TRACKING = r"(^|&)(utm_[a-z]*|ref|fbclid|gclid)=[^&]*"
ENDING = r"(/|/index\.html?|\.html?)$"
CANONICAL = r"(?i)<link[^>]*rel=[\"']?canonical[\"']?[^>]*>"
HREF = r"(?i)href=[\"']?([^\"'> ]+)"
REFRESH = r"(?i)<meta[^>]*http-equiv=[\"']?refresh[\"']?[^>]*>"
TARGET = r"(?i)url=[\"']?([^\"'> ]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), HOST_PATH, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), HOST_PATH, 2)


def key_of(url: Column) -> Column:
    """A url without scheme, fragment, tracking parameters and ending: what aliases by spelling have in common. Null without a host."""
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, QUERY, 1), TRACKING, ""), "^&", "")
    key = F.concat(host_of(url), F.regexp_replace(path_of(url), ENDING, ""), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host_of(url) != "", key)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. ``rules`` is a short list, written into the plan."""
    found = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        then = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, then) if found is None else found.when(fits, then)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def links(pages: DataFrame) -> DataFrame:
    """(url, target) for each canonical link and meta refresh, rooted targets made absolute."""
    tags = (F.regexp_extract(F.regexp_extract("html", CANONICAL, 0), HREF, 1), F.regexp_extract(F.regexp_extract("html", REFRESH, 0), TARGET, 1))
    raw = pages.select("url", F.explode(F.array(*tags)).alias("raw")).filter("url IS NOT NULL AND raw <> ''")
    target = F.when(F.col("raw").startswith("//"), F.concat(F.lit("http:"), F.col("raw")))
    target = target.when(F.col("raw").startswith("/"), F.concat(F.lit("http://"), host_of(F.col("url")), F.col("raw")))
    return raw.select("url", target.when(F.col("raw").contains("://"), F.col("raw")).alias("target")).filter("target IS NOT NULL")


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and decided_by (rule, alias or default) for each row of ``pages`` (page_id, url, html)."""
    url = F.col("url")
    own = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    own = own.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("key", key_of(url))
    edges = saved(links(pages.select("url", "html")))
    to, target = F.col("target"), edges.select("target")
    ends = edges.select(key_of(url).alias("a"), key_of(to).alias("b"))
    aliases = components(ends)
    # Decisions by rule, of the pages and of targets that are no page, one row for each key before the shuffle.
    decided = own.select("key", F.col("r.verdict").alias("verdict")).unionByName(
        target.select(key_of(to).alias("key"), rule_of(host_of(to), path_of(to), rules)["verdict"].alias("verdict"))
    ).filter("key IS NOT NULL AND verdict IS NOT NULL").distinct()
    group = F.coalesce("component", "key")
    of_group = (
        decided.join(aliases.withColumnRenamed("node", "key"), "key", "left")
        .groupBy(group.alias("group")).agg(F.when(F.bool_or(F.col("verdict") == "allow"), "allow").otherwise("block").alias("by_alias"))
    )
    keys = own.filter("r IS NULL AND key IS NOT NULL").select("key").distinct()
    by_key = keys.join(aliases.withColumnRenamed("node", "key"), "key", "left").select("key", group.alias("group")).join(of_group, "group").select("key", "by_alias")
    undecided = own.filter("r IS NULL").join(by_key, "key", "left")
    return own.filter("r IS NOT NULL").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"), F.lit("rule").alias("decided_by")
    ).unionByName(
        undecided.select(
            "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("by_alias", F.lit("allow")).alias("verdict"),
            F.when(F.col("by_alias").isNull(), "default").otherwise("alias").alias("decided_by"),
        )
    )


def op4_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace('\\"', '"').replace("'", "''") + "'"


def _rule_sql(host: str, path: str) -> str:
    order = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2]))
    return "CASE " + " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{h}{p} {v}'" for h, p, v in order) + " END"


def _host_sql(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), {_quoted(HOST_PATH)}, 1), '{UPPER}', '{LOWER}')"


def _path_sql(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), {_quoted(HOST_PATH)}, 2)"


def _key_sql(url: str) -> str:
    query = f"regexp_replace(regexp_replace(regexp_extract({url}, {_quoted(QUERY)}, 1), {_quoted(TRACKING)}, '', 'g'), '^&', '')"
    return f"{_host_sql(url)} || regexp_replace({_path_sql(url)}, {_quoted(ENDING)}, '') || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"


ORACLE = f"""
WITH RECURSIVE own AS (
  SELECT page_id, url, {_host_sql('url')} AS host, {_path_sql('url')} AS path,
    CASE WHEN {_host_sql('url')} <> '' THEN {_key_sql('url')} END AS key
  FROM pages
), ruled AS (SELECT *, {_rule_sql('host', 'path')} AS r FROM own),
raw AS (
  SELECT url, raw FROM (
    SELECT url, regexp_extract(regexp_extract(html, {_quoted(CANONICAL)}, 0), {_quoted(HREF)}, 1) AS raw FROM pages
    UNION ALL SELECT url, regexp_extract(regexp_extract(html, {_quoted(REFRESH)}, 0), {_quoted(TARGET)}, 1) FROM pages)
  WHERE url IS NOT NULL AND raw <> ''
), links AS (
  SELECT url, CASE WHEN starts_with(raw, '//') THEN 'http:' || raw WHEN starts_with(raw, '/') THEN 'http://' || {_host_sql('url')} || raw
    WHEN contains(raw, '://') THEN raw END AS target FROM raw
), edges AS (
  SELECT {_key_sql('url')} AS a, {_key_sql('target')} AS b FROM links WHERE target IS NOT NULL
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (
  SELECT a, a AS b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), decided AS (
  SELECT key, split_part(r, ' ', 2) AS verdict FROM ruled WHERE key IS NOT NULL AND r IS NOT NULL
  UNION SELECT key, split_part({_rule_sql('host', 'path')}, ' ', 2) FROM (
    SELECT {_key_sql('target')} AS key, {_host_sql('target')} AS host, {_path_sql('target')} AS path FROM links WHERE target IS NOT NULL)
  WHERE {_rule_sql('host', 'path')} IS NOT NULL
), around AS (SELECT a AS key, b AS other FROM reach UNION SELECT key, key FROM own WHERE key IS NOT NULL),
by_key AS (
  SELECT around.key, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS by_alias
  FROM around JOIN decided ON around.other = decided.key GROUP BY around.key
)
SELECT page_id, host, path, split_part(r, ' ', 1) AS rule,
  coalesce(split_part(r, ' ', 2), by_alias, 'allow') AS verdict,
  CASE WHEN r IS NOT NULL THEN 'rule' WHEN by_alias IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM ruled LEFT JOIN by_key USING (key)
"""
