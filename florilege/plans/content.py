"""Pages: parsed content, links, titles, URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions import hashing, text, urls
from florilege.operators import catalog, dedup, profile, trees
from florilege.plans import sqltext as q
from florilege.registry import query, table

_LINK = r"""(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>"""

SITE = "https://example.com"


def titles(pages: DataFrame) -> DataFrame:
    """pages with title and slug."""
    path = F.regexp_replace("url", "[?#].*$", "")
    return pages.withColumn("title", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).withColumn("slug", F.regexp_extract(path, "([^/]*)/?$", 1))


def links(pages: DataFrame) -> DataFrame:
    """A row per link: page_id, url, place (from 1), href, label."""
    found = F.regexp_extract_all("html", F.lit(_LINK), F.lit(0))
    rows = pages.select("page_id", "url", F.posexplode(found).alias("at", "whole"))
    return rows.select("page_id", "url", (F.col("at") + 1).cast("long").alias("place"), F.regexp_extract("whole", _LINK, 1).alias("href"), text.strip_html(F.regexp_extract("whole", _LINK, 2)).alias("label"))


_LINKS_SQL = f"""l AS (SELECT page_id, url, unnest(range(1, len(a) + 1)) AS place, a FROM (SELECT page_id, url, regexp_extract_all(html, '{_LINK}') AS a FROM pages)),
k AS (SELECT page_id, url, place, regexp_extract(a[place], '{_LINK}', 1) AS href, {q.strip_html(f"regexp_extract(a[place], '{_LINK}', 2)")} AS label FROM l),
r AS (SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href ELSE href END AS target FROM k)"""


@query("S12 A10 A21 X20 P2", f"""SELECT page_id, CAST(length(html) AS BIGINT) AS html_length, CAST(len(regexp_extract_all(html, '(?i)<a\\b')) AS BIGINT) AS n_links, CAST(len(regexp_extract_all(html, '(?i)<img\\b')) AS BIGINT) AS n_images,
CAST(len(regexp_extract_all(html, '(?i)<h[1-3]\\b')) AS BIGINT) AS n_headings, CAST(len(regexp_extract_all({q.strip_html("html")}, '[\\p{{L}}\\p{{N}}_]+')) AS BIGINT) AS words FROM pages""")
def content_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda pattern: F.size(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("html_length"), count(r"(?i)<a\b").alias("n_links"), count(r"(?i)<img\b").alias("n_images"), count(r"(?i)<h[1-3]\b").alias("n_headings"), text.word_count(text.strip_html(F.col("html"))).alias("words"))


@query("S12 F1 F2 X32 X33 P2 W5", f"""WITH {_LINKS_SQL} SELECT page_id, place, target, regexp_extract(lower(target), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) AS domain, regexp_matches(lower(target), '^https?://([^/?#]*\\.)?example\\.com([/?#:]|$)') AS internal, label FROM r WHERE NOT regexp_matches(lower(href), '^(mailto:|tel:|#)')""")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links(table(spark, sf_dir, "pages")).where(urls.is_navigation(F.col("href"))).withColumn("target", urls.resolved(F.col("url"), F.col("href")))
    return found.select("page_id", "place", "target", urls.authority(F.col("target")).alias("domain"), urls.is_internal(F.col("target"), F.lit(SITE)).alias("internal"), "label")


@query("A9 S12 X32", f"WITH {_LINKS_SQL} SELECT target, count(*) AS n, count(DISTINCT page_id) AS sources, min(url) AS first_source FROM r GROUP BY target")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links(table(spark, sf_dir, "pages")).withColumn("target", urls.resolved(F.col("url"), F.col("href")))
    return found.groupBy("target").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("sources"), F.min("url").alias("first_source"))


@query("O6 S12", f"WITH {_LINKS_SQL}, c AS (SELECT href, place, page_id, len(label) > 5 AS long_label FROM r) (SELECT * FROM c WHERE long_label ORDER BY href, page_id, place LIMIT 120) UNION ALL (SELECT * FROM c WHERE NOT long_label ORDER BY href, page_id, place LIMIT 25)")
def per_class_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links(table(spark, sf_dir, "pages")).select("href", "place", "page_id", (F.length("label") > 5).alias("long_label"))
    return catalog.limited_classes(found, "long_label", ["href", "page_id", "place"], 120, 25)


@query("A7 X2 Q4 W2", f"SELECT t AS title_key, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, {q.norm_text(q.title())} AS t FROM pages) WHERE t <> '' GROUP BY t HAVING count(*) > 1")
def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = titles(table(spark, sf_dir, "pages")).select("page_id", text.norm_text(F.col("title")).alias("title_key")).where("title_key <> ''")
    return keyed.groupBy("title_key").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


_TITLE_TOKENS = f"list_distinct(list_filter(string_split({q.norm_text(q.title())}, ' '), lambda t: len(t) > 2 AND t NOT IN {q.STOP}))"


@query("X41 U3 F5 F13 X4 Q3", f"""WITH t AS (SELECT page_id, {_TITLE_TOKENS} AS a, list_distinct(list_filter(string_split({q.norm_text("replace(replace(regexp_replace(url, '[?#].*$', ''), 'https://', ''), 'http://', '')")}, ' '), lambda t: len(t) > 2 AND t NOT IN {q.STOP})) AS b FROM pages)
SELECT page_id, CAST(len(a) AS BIGINT) AS title_tokens, CAST(len(list_intersect(a, b)) AS BIGINT) AS common, len(a) >= 4 AND len(list_intersect(a, b)) < 0.35 * len(a) AS suspicious FROM t""")
def title_slug_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "https?://", "")
    both = titles(table(spark, sf_dir, "pages")).select("page_id", text.slug_tokens(F.col("title")).alias("a"), text.slug_tokens(address).alias("b"))
    common = F.size(F.array_intersect("a", "b")).cast("long")
    return both.select("page_id", F.size("a").cast("long").alias("title_tokens"), common.alias("common"), ((F.size("a") >= 4) & (common < 0.35 * F.size("a"))).alias("suspicious"))


_BARE = "regexp_extract(lower(url), '^[a-z]+://[^/?#]*') || regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z]+://[^/]*(/.*)$', 1), ''), '/'), '/{2,}', '/', 'g'), ';[^/]*$', '')"


@query("X30", f"""SELECT page_id, 'given' AS form, {_BARE} || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_')), '&'), ''), '') AS address FROM pages
UNION ALL SELECT page_id, 'odd', {_BARE} || '?b=x+y&c=~&d=&e=%2A' FROM pages""")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as they are, and with parameters, a query and a fragment that change."""
    odd = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit(";s=1?b=x y&UTM_a=1&c=%7E&&d&e=*#f"))
    both = table(spark, sf_dir, "pages").select("page_id", F.explode(F.create_map(F.lit("given"), "url", F.lit("odd"), odd)).alias("form", "url"))
    return both.select("page_id", "form", urls.canonical(F.col("url")).alias("address"))


@query("F2 X33 A11 O2", "SELECT CASE WHEN regexp_matches(url, '^https?://([^/?#]*\\.)?example\\.com([/?#:]|$)') THEN 'internal' ELSE regexp_extract(url, '^https?://[^/?#]*\\.(example\\.[a-z]+)', 1) END AS area, count(*) AS n FROM pages GROUP BY 1")
def pages_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = F.when(urls.is_internal(F.col("url"), F.lit("http://example.com")), "internal").otherwise(F.regexp_extract(urls.host(F.col("url")), r"(example\.[a-z]+)$", 1))
    return profile.frequencies(table(spark, sf_dir, "pages"), area.alias("area")).orderBy(F.desc("n"), "area")


@query("A1 O2", "SELECT lower(t) AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '<([A-Za-z][A-Za-z0-9]*)', 1)) AS t FROM pages) GROUP BY 1")
def tag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.regexp_replace("html", r"(?is)<script\b.*?</script>", " ")
    tags = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all(page, F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("tag"))
    return profile.frequencies(tags.select(F.lower("tag").alias("tag")), "tag").orderBy(F.desc("n"), "tag")


@query("A1 A15 X42 S12")
def tag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests hold it against a reading of the pages by patterns."""
    nodes = trees.html_nodes(table(spark, sf_dir, "pages"), "page_id", "html")
    return profile.frequencies(nodes.select(F.col("above").alias("parent"), F.col("name").alias("tag"), F.col("depth").cast("long").alias("depth")), "parent", "tag", "depth")


@query("A2 A3 F17", "SELECT lower(a) AS attribute, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '\\s([a-z-]+)=\"[^\"]*\"', 1)) AS a FROM pages) WHERE lower(a) IN ('class', 'lang', 'charset', 'href') GROUP BY 1")
def attribute_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r"""\s([a-z-]+)="[^"]*\""""), F.lit(1))).alias("a"))
    return profile.frequencies(names.select(F.lower("a").alias("attribute")).where(F.col("attribute").isin("class", "lang", "charset", "href")), "attribute")


@query("S14 X44 X43", "SELECT page_id, CAST(regexp_extract(html, 'track\\((\\d+)\\)', 1) AS BIGINT) AS tracked, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages WHERE regexp_matches(html, 'track\\(\\d+\\)')")
def embedded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract("html", r"track\((\d+)\)", 1)
    return table(spark, sf_dir, "pages").where(found != "").select("page_id", found.cast("long").alias("tracked"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"))


@query("P5 U1 X16", f"""SELECT page_id, 'title' AS field, CAST(length({q.strip_html(q.title())}) AS BIGINT) AS size FROM pages UNION ALL SELECT page_id, 'slug', CAST(length({q.slug()}) AS BIGINT) FROM pages UNION ALL SELECT page_id, 'body', CAST(length({q.strip_html("html")}) AS BIGINT) FROM pages""")
def unpivoted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = titles(table(spark, sf_dir, "pages")).select("page_id", text.strip_html(F.col("title")).alias("title"), "slug", text.strip_html(F.col("html")).alias("body"))
    return wide.unpivot("page_id", ["title", "slug", "body"], "field", "value").select("page_id", "field", F.length("value").cast("long").alias("size"))


@query("J19 X32", "SELECT page_id, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages WHERE url LIKE '%#%' AND NOT contains(html, 'id=\"' || regexp_extract(url, '#(.*)$', 1) || '\"')")
def dangling_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    wanted = pages.select("page_id", F.regexp_extract("url", "#(.*)$", 1).alias("fragment")).where("fragment <> ''")
    ids = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('id="([^"]*)"'), F.lit(1))).alias("fragment"))
    return wanted.join(ids, ["page_id", "fragment"], "left_anti")


@query("A23 X38", "SELECT page_id, sha256(html) AS sha256 FROM pages")
def page_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


@query("X34 X8 X14 X15 X18 X22", f"""SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'w=' || page_id AS thumbnail,
regexp_replace(regexp_replace({q.fold(q.title())}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS file_name, replace(replace(replace(replace({q.title()}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
CASE WHEN length({q.strip_html("html")}) <= 140 THEN {q.strip_html("html")} ELSE substr({q.strip_html("html")}, 1, 139) || '…' END AS teaser,
array_to_string(string_split({q.strip_html(q.title())}, ' ')[1:5], ' ') || CASE WHEN len(string_split({q.strip_html(q.title())}, ' ')) > 5 THEN '…' ELSE '' END AS card FROM pages""")
def page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(table(spark, sf_dir, "pages")).select(
        "page_id", urls.with_parameter(F.col("url"), "w", F.col("page_id")).alias("thumbnail"), text.slugify(F.col("title")).alias("file_name"), text.escape_markup(F.col("title")).alias("escaped"),
        text.shortened(F.col("html")).alias("teaser"), text.trimmed_words(text.strip_html(F.col("title")), 5).alias("card"),
    )


@query("M6", "SELECT page_id, length(regexp_replace(html, '(?s)<article>.*?</article>', '<article>' || chr(10) || page_id || chr(10) || '</article>')) AS size FROM pages")
def replaced_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from florilege.operators.reconcile import replace_block

    return table(spark, sf_dir, "pages").select("page_id", F.length(replace_block(F.col("html"), "<article>", "</article>", F.col("page_id").cast("string"))).cast("long").alias("size"))


@query("W6 S5 U5", "SELECT CAST(min(page_id) AS BIGINT) AS page_id, address FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS address FROM pages) GROUP BY address")
def first_of_each_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("address"))
    return dedup.first_seen(keyed, ["address"], ["page_id"])


@query("M2 W1 A19 X38", """WITH d AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS own, left(sha256('=' || html), 24) AS dg FROM pages), u AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY own) = 1 THEN 'own:' || own ELSE dg END AS k FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY page_id) AS nth FROM u) SELECT page_id, CASE WHEN nth = 1 THEN k ELSE k || ':duplicate:' || nth END AS key FROM n""")
def page_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return dedup.identities(pages, hashing.digest(F.col("html")), F.col("page_id"), F.regexp_replace("url", "[?#].*$", "")).select("page_id", "key")
