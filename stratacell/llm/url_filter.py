"""URL filters with redirect equivalence.

A rule names a host and a path prefix; it fits its host and all subdomains. URLs
that redirect to each other, or name each other as canonical, are one place:
connected components over those edges carry a rule's decision to aliases that no
rule fits. A URL's own rule comes first; among aliases an allow comes before a
block; without either the verdict is allow.

All canonical links and refresh redirects of a page count, as HTML has them: tags
outside comments, scripts and styles; attributes by name, the first of a name, with
blanks around ``=``, in either quotes or none; ``rel`` as a list of words; numeric
character references and the five of XML; a refresh with or without ``url=``. A
relative target is resolved against the page's first ``base``, or else its url, as
URLs are (scheme, ``//host``, ``/path``, ``?query``, or a path from the last slash;
``.`` and ``..`` are taken out). Not read: other named references, redirects by
script or by HTTP headers, and what browsers make of malformed tags.

Defined results: a null url or one without ``://`` has an empty host and path and
no aliases, and is allowed. Of equally long rules the one with the longer host
wins. Urls and pages may have any length. Repeated rows are judged one by one.
Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, stored

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER = r"^[\s\S]*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), AFTER, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), AFTER, 2)


def best_rule(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; of equally long ones that with the longer host."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rh, rp in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        rule, verdict = F.when(fits, rh + rp).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def without_dots(p: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    kept = F.aggregate(
        F.split(p, "/"), F.array().cast("array<string>"),
        lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.least(F.size(a), F.lit(1))))).otherwise(F.concat(a, F.array(x))),
    )
    return F.when(F.contains(p, F.lit("/.")), F.concat(F.array_join(kept, "/"), F.when(F.regexp_like(p, F.lit(r"/\.\.?$")), "/").otherwise(""))).otherwise(p)


def place(url: Column) -> Column:
    """What makes two URLs the same place: host, path and query, without scheme and fragment; null without a host."""
    query = F.regexp_extract(url, r"^[\s\S]*?://[^?#]*(\?[^#]*)?", 1)
    return F.when(host(url) != "", F.concat(host(url), without_dots(path(url)), F.coalesce(query, F.lit(""))))


def resolved(to: Column, url: Column) -> Column:
    """The target ``to`` of a link on the page at ``url``."""
    root = F.concat(F.lit("http://"), host(url))
    folder = F.concat(F.regexp_extract(path(url), r"^([\s\S]*/)?", 1))
    return (
        F.when(F.regexp_like(to, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), to).when(to.startswith("//"), F.concat(F.lit("http:"), to)).when(to.startswith("/"), F.concat(root, to))
        .when(to.startswith("?"), F.concat(root, path(url), to)).when(to.startswith("#"), url).otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), to))
    )


#: What is no markup: comments, and the bodies of scripts and styles; an open one goes to the end.
HIDDEN = r"(?i)<!--[\s\S]*?(?:-->|$)|<script(?=[\s/>])[\s\S]*?(?:</script\s*>|$)|<style(?=[\s/>])[\s\S]*?(?:</style\s*>|$)"
ATTRIBUTE = r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
REFERENCE = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&(?:amp|lt|gt|quot|apos);"
NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
REFRESH = r"^\s*[0-9][0-9.]*\s*(?:[;,]|\s)\s*(?:[uU][rR][lL]\s*=\s*)?"


def tags(html: Column, name: str) -> Column:
    """The tags of a name, whole; a quoted value may hold ``>``."""
    return F.regexp_extract_all(html, F.lit(rf"""(?i)<{name}(?=[\s/])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""), F.lit(0))


def character(reference: Column) -> Column:
    """What a character reference stands for; a replacement character where there is no such one."""
    digits = F.regexp_extract(reference, r"^&#[xX]?0*([0-9a-fA-F]*)", 1)
    decimal = F.when(F.regexp_like(reference, F.lit("^&#[xX]")), F.conv(digits, 16, 10)).otherwise(digits)
    n = F.when(F.length(digits) < 8, F.coalesce(decimal.try_cast("long"), F.lit(0))).otherwise(0)
    fine = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    out = F.when(fine, F.decode(F.unhex(F.lpad(F.hex(F.when(fine, n).otherwise(65)), 8, "0")), "UTF-32")).otherwise("�")
    for name, c in NAMED.items():
        out = F.when(reference == name, c).otherwise(out)
    return out


def spelt(value: Column) -> Column:
    """A value with its character references resolved, in one pass."""
    between, found = F.split(value, REFERENCE, -1), F.regexp_extract_all(value, F.lit(REFERENCE), F.lit(0))
    joined = F.array_join(F.zip_with(between, F.transform(found, character), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.contains(value, F.lit("&")), joined).otherwise(value)


def named(attribute: str) -> Column:
    """The value of the first attribute of a name, as it is written, from ``names`` and ``values``; null without one."""
    raw = F.get("values", F.array_position("names", attribute).cast("int") - 1)
    return F.when(F.array_contains("names", attribute), raw)


def unquoted(value: Column) -> Column:
    return F.when(F.substring(value, 1, 1).isin("'", '"'), F.regexp_replace(value, r"""^["']|["']$""", "")).otherwise(value)


def address(value: Column) -> Column:
    """A URL as an attribute holds it: without blanks around it, line breaks and tabs."""
    return F.regexp_replace(F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` behind a generator, past which Spark moves no filter: one over what is below would repeat each expression as often
    as those above name it."""
    return rows.select(F.explode(F.array(F.struct(*[f"`{c}`" for c in rows.columns]))).alias("r")).select("r.*")


def attributes(rows: DataFrame, *wanted: str) -> DataFrame:
    """``rows`` (.., tag) with a column for each wanted attribute of the tag; step by step, so that nothing is worked out twice."""
    names = F.transform(F.regexp_extract_all("tag", F.lit(ATTRIBUTE), F.lit(1)), lambda n: F.lower(n))
    rows = rows.select("*", names.alias("names"), F.regexp_extract_all("tag", F.lit(ATTRIBUTE), F.lit(2)).alias("values"))
    rows = rows.withColumns({w: named(w) for w in wanted}).drop("tag", "names", "values")
    rows = settled(rows.withColumns({w: unquoted(F.col(f"`{w}`")) for w in wanted}))
    return settled(rows.withColumns({w: spelt(F.col(f"`{w}`")) for w in wanted}))


def links(pages: DataFrame) -> DataFrame:
    """(u, v): the place of each page and those that its canonical links and refresh redirects name."""
    rows = pages.where("url is not null").where(F.regexp_like("html", F.lit(r"(?i)<(?:link|meta)[\s/]"))).select("url", F.regexp_replace("html", HIDDEN, " ").alias("html"))
    html = F.col("html")
    first_base = F.get(F.filter(tags(html, "base"), lambda t: F.exists(F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(1)), lambda n: F.lower(n) == "href")), 0)
    rows = rows.select("url", F.concat(tags(html, "link"), tags(html, "meta")).alias("tags"), first_base.alias("tag"))
    rows = attributes(rows, "href").select("url", "tags", address(F.col("href")).alias("base"))
    rows = rows.select(F.when(F.col("base") != "", resolved(F.col("base"), F.col("url"))).otherwise(F.col("url")).alias("base"), "url", F.explode("tags").alias("tag"))
    rows = rows.withColumn("kind", F.lower(F.substring("tag", 2, 4)))
    rows = attributes(rows, "rel", "href", "http-equiv", "content")
    content = F.col("content")
    rest = F.when(F.regexp_like(content, F.lit(REFRESH)), F.regexp_replace(content, REFRESH, ""))
    rows = settled(rows.withColumns({
        "canonical": (F.col("kind") == "link") & F.array_contains(F.split(F.lower("rel"), r"\s+"), "canonical"),
        "refresh": (F.col("kind") == "meta") & (F.trim(F.lower("`http-equiv`")) == "refresh"), "rest": rest,
    }))
    quoted = lambda q: F.substring_index(F.substr("rest", F.lit(2)), q, 1)
    target = F.when(F.col("rest").startswith('"'), quoted('"')).when(F.col("rest").startswith("'"), quoted("'")).otherwise(F.col("rest"))
    rows = settled(rows.select("url", "base", address(F.when(F.col("canonical"), F.col("href")).when(F.col("refresh"), target)).alias("to"))).where("to <> ''")
    rows = settled(rows.select("url", resolved(F.col("to"), F.col("base")).alias("to")))
    return settled(rows.select(place(F.col("url")).alias("u"), place(F.col("to")).alias("v"))).where("u is not null and v is not null and u <> v").distinct()


def verdicts(pages: DataFrame, edges: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page. ``edges``: (u, v) of places, by default those of :func:`links`."""
    edges = stored(links(pages) if edges is None else edges, "url-edges")
    h, p = host(F.col("url")), path(F.col("url"))
    rows = pages.select("page_id", place(F.col("url")).alias("place"), h.alias("host"), p.alias("path"))
    rule, own = best_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), own.alias("own"))
    if edges.isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    # places that no page has can carry a rule too
    roots = stored(components(edges), "url-roots")
    _, said = best_rule(F.regexp_extract("node", r"^[^/?]*", 0), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1), rules)
    # stored before the joins, so that a place or component with a large share of the rows can be split there
    by_root = stored(roots.groupBy("root").agg(F.min(said).alias("said")).where("said is not null"), "url-said")  # allow sorts before block
    alias = stored(roots.join(by_root, "root").select(F.col("node").alias("place"), "said"), "url-aliases")
    asks = F.col("place").isNotNull() & F.col("own").isNull()  # only pages without a rule of their own look for an alias
    found = rows.where(asks).join(alias, "place", "left").select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"))
    return rows.where(~asks).select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict")).unionByName(found)


def query(spark, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _case(column: str) -> str:
    out = "CASE"
    for said, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]))):
        out += f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{said if column == 'verdict' else h + p}'"
    return out + " END"


def _dots(path: str) -> str:
    """The path without dot segments, in SQL."""
    return f"""CASE WHEN contains({path}, '/.') THEN array_to_string(list_reduce([[x] for x in string_split({path}, '/')],
    lambda a, x: CASE WHEN x[1] = '.' THEN a WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, least(len(a), 1))] ELSE list_concat(a, x) END), '/')
    || CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN '/' ELSE '' END ELSE {path} END"""


def _url_parts(url: str) -> str:
    return rf"translate(regexp_extract(coalesce({url}, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce({url}, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 2) AS path"


def _resolved(to: str) -> str:
    return rf"""CASE WHEN regexp_matches({to}, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN {to} WHEN starts_with({to}, '//') THEN 'http:' || {to} WHEN starts_with({to}, '/') THEN 'http://' || host || {to}
  WHEN starts_with({to}, '?') THEN 'http://' || host || path || {to} WHEN starts_with({to}, '#') THEN url
  ELSE 'http://' || host || CASE WHEN contains(path, '/') THEN regexp_extract(path, '^([\s\S]*/)?', 1) ELSE '/' END || {to} END"""


SQL = rf"""
WITH RECURSIVE a AS (SELECT page_id, url, html, translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 2) AS path, regexp_extract(url, '^[\s\S]*?://[^?#]*(\?[^#]*)?', 1) AS q FROM pages),
p AS (SELECT *, CASE WHEN host <> '' THEN host || ({_dots("path")}) || coalesce(q, '') END AS place, {_case("rule")} AS rule, {_case("verdict")} AS own FROM a),
h AS MATERIALIZED (SELECT row_number() OVER () AS page, place, url, regexp_replace(html, '(?i)<!--(?:.|\n)*?(?:-->|$)|<script[\s/>](?:.|\n)*?(?:</script\s*>|$)|<style[\s/>](?:.|\n)*?(?:</style\s*>|$)', ' ', 'g') AS html FROM p WHERE place IS NOT NULL AND html IS NOT NULL),
tag AS MATERIALIZED (SELECT row_number() OVER () AS tag, page, lower(regexp_extract(x, '^<(\w+)', 1)) AS name, x, i FROM (SELECT page, unnest(x) AS x, unnest(range(len(x))) AS i FROM (SELECT page, regexp_extract_all(html, '(?i)<(?:link|meta|base)[\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*>') AS x FROM h))),
att AS (SELECT tag, lower(regexp_extract(y, '^[^\s=]+')) AS att, regexp_replace(y, '^[^\s=]+\s*=\s*', '') AS v, j FROM (SELECT tag, unnest(y) AS y, unnest(range(len(y))) AS j FROM (SELECT tag, regexp_extract_all(x, '[^\s"''<>/=]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)') AS y FROM tag))),
one AS (SELECT tag, att, CASE WHEN v[1] IN ('"', '''') THEN v[2:-2] ELSE v END AS v FROM att QUALIFY row_number() OVER (PARTITION BY tag, att ORDER BY j) = 1),
amp AS (SELECT tag, att, string_split(v, '&') AS parts FROM one),
said AS MATERIALIZED (SELECT tag, att, parts[1] || array_to_string(list_transform(parts[2:], lambda y: CASE
  WHEN regexp_matches(y, '^#[xX][0-9a-fA-F]+') THEN chr(CAST('0x' || regexp_extract(y, '^#[xX]([0-9a-fA-F]+)', 1) AS INTEGER)) || regexp_replace(y, '^#[xX][0-9a-fA-F]+;?', '')
  WHEN regexp_matches(y, '^#[0-9]+') THEN chr(CAST(regexp_extract(y, '^#([0-9]+)', 1) AS INTEGER)) || regexp_replace(y, '^#[0-9]+;?', '')
  WHEN starts_with(y, 'amp;') THEN '&' || y[5:] WHEN starts_with(y, 'lt;') THEN '<' || y[4:] WHEN starts_with(y, 'gt;') THEN '>' || y[4:] WHEN starts_with(y, 'quot;') THEN '"' || y[6:] WHEN starts_with(y, 'apos;') THEN '''' || y[6:]
  ELSE '&' || y END), '') AS v FROM amp),
whole AS (SELECT tag.page, tag.i, name, max(v) FILTER (WHERE att = 'rel') AS rel, max(v) FILTER (WHERE att = 'href') AS href, max(v) FILTER (WHERE att = 'http-equiv') AS equiv, max(v) FILTER (WHERE att = 'content') AS content FROM tag JOIN said USING (tag) GROUP BY ALL),
goal AS (SELECT page, i, href AS to_ FROM whole WHERE name = 'link' AND list_contains(regexp_split_to_array(lower(rel), '\s+'), 'canonical')
  UNION ALL SELECT page, i, CASE WHEN r[1] = '"' THEN string_split(r[2:], '"')[1] WHEN r[1] = '''' THEN string_split(r[2:], '''')[1] ELSE r END FROM (SELECT page, i, regexp_replace(content, '^\s*[0-9][0-9.]*\s*(?:[;,]|\s)\s*(?:[uU][rR][lL]\s*=\s*)?', '') AS r
    FROM whole WHERE name = 'meta' AND trim(lower(equiv)) = 'refresh' AND regexp_matches(content, '^\s*[0-9][0-9.]*\s*(?:[;,]|\s)'))),
root AS (SELECT page, href FROM whole WHERE name = 'base' AND href IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page ORDER BY i) = 1),
clean AS (SELECT h.place, h.url, translate(trim(to_, chr(32) || chr(9) || chr(10) || chr(13)), chr(9) || chr(10) || chr(13), '') AS to_, translate(trim(root.href, chr(32) || chr(9) || chr(10) || chr(13)), chr(9) || chr(10) || chr(13), '') AS base FROM goal JOIN h USING (page) LEFT JOIN root USING (page)),
b0 AS (SELECT *, {_url_parts("url")} FROM clean),
b1 AS (SELECT place, to_, CASE WHEN coalesce(base, '') = '' THEN url ELSE {_resolved("base")} END AS url FROM b0),
g AS (SELECT *, {_url_parts("url")} FROM b1 WHERE to_ <> ''),
f AS (SELECT place, {_resolved("to_")} AS u FROM g),
o AS (SELECT place, translate(regexp_extract(u, '^[\s\S]*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS h, regexp_extract(u, '^[\s\S]*?://([^/?#]*)([^?#]*)', 2) AS p2,
  regexp_extract(u, '^[\s\S]*?://[^?#]*(\?[^#]*)?', 1) AS q2 FROM f),
e AS (SELECT place AS a, h || ({_dots("p2")}) || q2 AS b FROM o WHERE h <> ''),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS other FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.other = s.a),
k AS (SELECT node, min({_case("verdict")}) AS said FROM (SELECT node, regexp_extract(other, '^[^/?]*') AS host, regexp_extract(other, '^[^/?]*([^?]*)', 1) AS path FROM r) GROUP BY node)
SELECT page_id, host, path, rule, coalesce(own, said, 'allow') AS verdict FROM p LEFT JOIN k ON place = node
"""
