"""URL filters: longest-rule verdicts, carried over redirect and canonical-link equivalence.

Pages are linked when they state the same alias key: their own address in a normal form (what
http/https, www, trailing-slash and tracking-parameter redirects lead to), the target of their
``<link rel=canonical>`` or meta refresh, or a given redirect's target. Connected components over
these links are the sets of aliases. A page's own rule always decides; a page that no rule fits is
blocked if a page of its component is blocked by a rule, else allowed. So an explicit allow takes
precedence over a block that comes by an alias, and shields only its own page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import connected_components, join_small, materialize, or_empty, read_table

#: Fixed values: (host and path, verdict).
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that redirects drop.
TRACKING = r"(?i)(?:^|&)(?:utm_[a-z]+|gclid|fbclid|ref|source)=[^&]*"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(or_empty(url), ADDRESS, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(or_empty(url), ADDRESS, 2)


def alias_key(url: Column) -> Column:
    """The normal form of an address; null where there is no host."""
    name = F.regexp_replace(host(url), r"^www\.|:(?:80|443)$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(or_empty(url), ADDRESS, 3), TRACKING, ""), "^&", "")
    key = F.concat(name, F.regexp_replace(path(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(name != "", key)


def _resolve(link: Column, url: Column) -> Column:
    """An absolute address from a link found on a page; null for an empty one."""
    link = F.trim(link)
    base = F.concat(F.lit("http://"), host(url))
    folder = F.concat(base, F.regexp_replace(path(url), "[^/]*$", ""))
    return (
        F.when(link == "", F.lit(None)).when(link.contains("://"), link).when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(base, link)).otherwise(F.concat(folder, link))
    )


def page_links(html: Column, url: Column) -> Column:
    """The addresses that a page names as its canonical form or refreshes to."""
    head = or_empty(html)
    tag = F.regexp_extract(head, r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    canonical = F.regexp_extract(tag, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(head, r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    return F.array(_resolve(canonical, url), _resolve(refresh, url))


def longest_rule(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(_row, rule, _own) for rows of ``pages`` (_row, host, path) that a rule (rule, verdict) fits.

    Hosts are matched by equality with each suffix of the page's host that has no more labels than
    the rules have, so that a long rule list is an equi-join and a host of many labels costs no more
    than its length; the path prefix is a condition on what meets there.
    """
    rules = rules.select(F.col("rule"), F.col("verdict").alias("_own"), F.regexp_extract("rule", "^([^/]*)", 1).alias("_suffix"), F.regexp_extract("rule", "(?s)^[^/]*(.*)$", 1).alias("_prefix"))
    dots = F.length("_suffix") - F.length(F.replace("_suffix", F.lit("."), F.lit("")))
    most = rules.agg(F.max(dots)).first()[0]
    suffixes = F.expr(f"transform(sequence(1, least({(most or 0) + 1}, length(host) - length(replace(host, '.', '')) + 1)), i -> substring_index(host, '.', -i))")
    hit = join_small(pages.filter("host <> ''").select("_row", "path", F.explode(suffixes).alias("_suffix")), rules, ["_suffix"]).filter("startswith(path, _prefix)")
    best = hit.groupBy("_row").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "_own")).alias("_best"))
    return best.select("_row", "_best.rule", "_best._own")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, component, verdict: one row per input row.

    ``redirects``: (source_url, target_url). Rows with equal page_id are one page with several
    addresses. A null page_id or an address without host links with nothing; a null html states no
    links. Extra columns are left out. Empty tables give no rows.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    p = p.withColumns({"host": host(F.col("url")), "path": path(F.col("url")), "_links": page_links(F.col("html"), F.col("url")), "_row": F.monotonically_increasing_id()}).drop("html")
    p = materialize(p, "pages")
    keys = p.select("page_id", F.explode(F.array_union(F.array(alias_key(F.col("url"))), F.transform("_links", alias_key))).alias("key"))
    if redirects is not None:
        r = redirects.select(alias_key(F.col("source_url")).alias("key"), alias_key(F.col("target_url")).alias("_to")).filter("key is not null and _to is not null").distinct()
        keys = keys.union(keys.join(r, "key").select("page_id", F.col("_to").alias("key")))
    keys = keys.filter("key is not null and page_id is not null").distinct()
    shared = keys.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    edges = keys.join(shared, "key").select(F.col("page_id").alias("a"), F.col("first").alias("b"))
    components = connected_components(edges)
    ruled = longest_rule(p, rules)
    p = p.join(ruled, "_row", "left").join(components, p["page_id"] == components["node"], "left").withColumn("component", F.coalesce("component", "page_id")).drop("node", "_row", "_links")
    p = materialize(p, "judged")
    blocked = p.filter("_own = 'block' and component is not null").select("component").distinct().withColumn("_blocked", F.lit(True))
    out = join_small(p, blocked, ["component"], "left")
    verdict = F.coalesce("_own", F.when(F.col("_blocked"), "block").otherwise("allow"))
    return out.select("page_id", "url", "host", "path", "rule", "component", verdict.alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return judge(read_table(spark, sf_dir, "pages"), rules).drop("url", "component")


#: The tables' pages state no canonical or refresh links, so a component there is the pages with one alias key.
OP5_SQL = r"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
p AS (SELECT page_id, translate(regexp_extract(u, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, regexp_extract(u, '^.*?://[^/?#]*[^?#]*\?([^#]*)', 1, 's') AS q FROM a),
rules(rule, own) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
r AS (SELECT rule, own, split_part(rule, '/', 1) AS h, substr(rule, position('/' IN rule)) AS s FROM rules),
best AS (SELECT page_id, rule, own FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1),
k AS (SELECT page_id, host, path, regexp_replace(host, '^www\.|:(?:80|443)$', '', 'g') AS name,
  regexp_replace(regexp_replace(q, '(?i)(?:^|&)(?:utm_[a-z]+|gclid|fbclid|ref|source)=[^&]*', '', 'g'), '^&', '') AS rest FROM p),
n AS (SELECT page_id, host, path, CASE WHEN name <> '' THEN name || regexp_replace(path, '/+$', '') || CASE WHEN rest <> '' THEN '?' || rest ELSE '' END END AS key FROM k)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN key IS NOT NULL AND bool_or(own = 'block') OVER (PARTITION BY key) THEN 'block' ELSE 'allow' END) AS verdict FROM n LEFT JOIN best USING (page_id)
"""
