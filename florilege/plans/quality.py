"""The issue report and what is read off it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege import sinks
from florilege.operators import profile
from florilege.operators.stored import shared_dir, stored
from florilege.plans import sqltext as q
from florilege.plans.content import titles
from florilege.registry import query, table
from florilege.rules import site
from florilege.rules.issues import combined, rank, ranked

#: Limits that the small stand-in pages reach, and typos that their titles hold.
HEAVY, FEW, SLUG = 12_000, 40, 3
PAGE_TYPOS = (("thth", "the"), ("ouou", "ou"))


def typed(pages: DataFrame) -> DataFrame:
    """pages with title, slug and a type: each second one is a post."""
    return titles(pages).withColumn("type", F.when(F.col("page_id") % 2 == 0, "page").otherwise("post"))


def page_issues(pages: DataFrame) -> DataFrame:
    """Every page rule over pages (page_id, url, html), stored, as it is sorted next."""
    pages = typed(pages)
    return stored(combined(site.page_rules(pages, HEAVY, FEW, SLUG, PAGE_TYPOS), site.duplicate_titles(pages)), "issues")


_TOKENS = lambda x: f"list_distinct(list_filter(string_split({q.norm_text(x)}, ' '), lambda t: len(t) > 2 AND t NOT IN {q.STOP}))"
_SHARE = "len(list_intersect(a, b)) / greatest(1, len(a))"
_TYPO_SQL = ", ".join(f"CASE WHEN contains(blob, '{bad}') THEN 'erro provável: {bad} -> {good}' END" for bad, good in PAGE_TYPOS)
_ISSUES_SQL = rf"""w AS (SELECT url, html, page_id % 2 = 0 AS page, {q.slug()} AS slug, {_TOKENS(q.title())} AS a, {_TOKENS(q.slug())} AS b, lower({q.strip_html(q.title())} || ' ' || {q.slug()}) AS blob FROM pages),
i AS (SELECT 'Técnico' AS area, 'Alta' AS severity, 'Página muito pesada' AS issue_type, url, length(html) || ' caracteres de HTML' AS evidence FROM w WHERE page AND length(html) > {HEAVY}
UNION ALL SELECT 'Conteúdo', 'Baixa', 'Post quase vazio', url, k || ' palavras' FROM (SELECT url, html, page, len(regexp_extract_all({q.strip_html("html")}, '[\p{{L}}\p{{N}}_]+')) AS k FROM w) WHERE NOT page AND k < {FEW} AND length(html) > 0 AND NOT regexp_matches(html, '(?i)<img\b')
UNION ALL SELECT 'Normalização', 'Média', 'Título/slug suspeito', url, e FROM (SELECT url, concat_ws('; ', CASE WHEN length(slug) > {SLUG} THEN 'slug muito longo' END, CASE WHEN {_SHARE} < 0.35 AND len(a) >= 4 THEN 'baixo alinhamento título/slug (' || CAST(round_even({_SHARE} * 100, 0) AS BIGINT) || '%)' END, {_TYPO_SQL}) AS e FROM w) WHERE e <> ''
UNION ALL SELECT 'Conteúdo', 'Média', 'Títulos duplicados', min(url), k || ': ' || count(*) FROM (SELECT url, {q.norm_text(q.title())} AS k FROM pages) WHERE k <> '' GROUP BY k HAVING count(*) > 1)"""


@query("Q1 Q2 Q3 Q4 F3 F4 F5 F10 X40 O1 P2", f"WITH {_ISSUES_SQL} SELECT area, severity, issue_type, url, left(evidence, 500) AS evidence FROM i")
def issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(page_issues(table(spark, sf_dir, "pages"))).drop("recommendation")


@query("O1 K4", f"WITH {_ISSUES_SQL} SELECT area, severity, issue_type, url, evidence FROM i ORDER BY CASE severity WHEN 'Crítica' THEN 0 WHEN 'Alta' THEN 1 WHEN 'Média' THEN 2 WHEN 'Baixa' THEN 3 ELSE 9 END, area, issue_type, url, evidence LIMIT 20")
def top_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(page_issues(table(spark, sf_dir, "pages"))).drop("recommendation").limit(20)


@query("A10 A11 O2 K4", f"WITH {_ISSUES_SQL} SELECT area, count(*) AS n, count(*) FILTER (severity IN ('Alta', 'Crítica')) AS grave FROM i GROUP BY area")
def issues_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_issues(table(spark, sf_dir, "pages"))
    return found.groupBy("area").agg(F.count("*").alias("n"), F.count_if(rank() <= 1).alias("grave")).orderBy(F.desc("n"), "area")


@query("X6 Q14")
def writing_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings about texts by kind; the repeated-word check needs a back-reference."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), "text")
    return site.writing(texts).groupBy("evidence", "severity").agg(F.count("*").alias("n"))


#: A typo of the stand-in category names.
TERM_TYPOS = (("united", "unified"),)

_TERMS_SQL = """SELECT issue_type, severity, evidence, count(*) AS n FROM (
SELECT 'Categorias equivalentes' AS issue_type, 'Alta' AS severity, k || ': ' || count(*) AS evidence FROM (SELECT DISTINCT p_brand, p_type, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS k FROM part) GROUP BY k HAVING count(*) > 1
UNION ALL SELECT 'Categoria a rever', CASE WHEN n_nationkey % 3 = 0 OR contains(lower(n_name), 'united') THEN 'Média' ELSE 'Baixa' END, n_name || ': ' || p FROM (SELECT *, concat_ws('; ', CASE WHEN n_nationkey % 3 = 0 THEN 'categoria sem posts' END, CASE WHEN n_regionkey + 3 NOT IN (SELECT r_regionkey FROM region) THEN 'parent inexistente na API' END, CASE WHEN contains(lower(n_name), 'united') THEN 'erro provável: united -> unified' END) AS p FROM nation) WHERE p <> ''
UNION ALL SELECT 'Uso residual de tags', 'Alta', tags || '/' || categories FROM (SELECT count(DISTINCT p_type) AS tags, 1001 AS categories FROM part) WHERE tags < 100
UNION ALL SELECT DISTINCT 'URLs fora do sitemap', 'Média', url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 10 <> 0)) GROUP BY 1, 2, 3"""


@query("Q7 Q5 Q10 Q11 F6", _TERMS_SQL)
def taxonomy_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equivalent, unused and misspelt categories, residual tags, pages outside the sitemap, on stand-in terms."""
    parts, regions = table(spark, sf_dir, "part"), table(spark, sf_dir, "region")
    names = parts.select("p_brand", "p_type").distinct().select(F.col("p_type").alias("name"), F.concat_ws("/", "p_brand", "p_type").alias("url"))
    known = regions.select(F.col("r_regionkey").alias("parent"), F.lit(True).alias("parent_known"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lower("n_name").alias("slug"), F.col("n_name").alias("url"), (F.col("n_nationkey") % 3).alias("count"), (F.col("n_regionkey") + 3).alias("parent"))
    terms = nations.join(known, "parent", "left")
    totals = parts.agg(F.count_distinct("p_type").alias("tags"), F.lit(1001).alias("categories")).withColumn("url", F.lit("/"))
    pages = table(spark, sf_dir, "pages")
    sitemap = pages.where("page_id % 10 <> 0").select("url")
    found = combined(site.equivalent_categories(names), site.unused_categories(terms, TERM_TYPOS), site.residual_tags(totals), site.outside_sitemap(pages, sitemap))
    return found.groupBy("issue_type", "severity", "evidence").agg(F.count("*").alias("n"))


@query("F7 Q12", """WITH t AS (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') AS records, CASE WHEN o_custkey % 11 = 0 THEN 'Analisar já' WHEN o_custkey % 13 = 0 THEN 'Vazia?' WHEN o_custkey % 3 = 0 THEN 'ok' END AS notes, CASE WHEN o_custkey % 17 <> 0 THEN min(o_orderpriority) END AS reference FROM orders GROUP BY o_custkey)
SELECT evidence FROM (SELECT k, concat_ws('; ', CASE WHEN contains(coalesce(notes, ''), 'Analisar') THEN 'marcada para analisar' END, CASE WHEN contains(coalesce(notes, ''), 'Vazia') OR records = 0 THEN 'sem registos/vazia' END, CASE WHEN reference IS NULL THEN 'sem referência' END) AS p, 'Tabela ' || k || ': ' || p AS evidence FROM t) WHERE p <> ''""")
def tables_to_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in tables, one per customer; its finished orders are the records."""
    key = F.col("o_custkey")
    notes = F.when(key % 11 == 0, "Analisar já").when(key % 13 == 0, "Vazia?").when(key % 3 == 0, "ok")
    tables = table(spark, sf_dir, "orders").groupBy(key).agg(F.count_if(F.col("o_orderstatus") == "F").alias("records"), F.when(key % 17 != 0, F.min("o_orderpriority")).alias("reference"))
    return site.tables_to_review(tables.select(F.concat(F.lit("Tabela "), key.cast("string")).alias("name"), notes.alias("notes"), "records", "reference")).select("evidence")


@query("F18 Q13", "SELECT url, coalesce(error, CAST(status AS VARCHAR)) AS evidence FROM (SELECT CAST(event_id AS VARCHAR) AS url, CASE WHEN event_type = 'error' THEN 'timed out' END AS error, CASE WHEN event_type <> 'error' THEN 200 + 100 * (event_id % 4) + event_id % 5 END AS status FROM events) WHERE error IS NOT NULL OR status >= 400")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in answers, one per event: a status that follows from its number, or no answer."""
    failed = F.col("event_type") == "error"
    status = F.when(~failed, 200 + 100 * (F.col("event_id") % 4) + F.col("event_id") % 5)
    checked = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("url"), F.when(failed, "timed out").alias("error"), status.cast("int").alias("status"))
    return site.broken_links(checked).select("url", "evidence")


_GRID = "'| ' || concat_ws(' | ', {}) || ' |'"
_REPORT_SQL = f"""WITH {_ISSUES_SQL}, t AS (SELECT * FROM i ORDER BY CASE severity WHEN 'Crítica' THEN 0 WHEN 'Alta' THEN 1 WHEN 'Média' THEN 2 WHEN 'Baixa' THEN 3 ELSE 9 END, area, issue_type, url, evidence LIMIT 20),
l AS (SELECT unnest(['# Audit', '| indicator | value |', '|---|---|', '## Main issues', '| severity | issue_type | url |', '|---|---|---|', '## By area', '| area | n |', '|---|---|', '## Advice', '- Start with the worst.']) AS line
UNION ALL SELECT '| issues | ' || count(*) || ' |' FROM i UNION ALL SELECT '| grave | ' || count(*) FILTER (severity IN ('Alta', 'Crítica')) || ' |' FROM i
UNION ALL SELECT {_GRID.format("severity, issue_type, replace(url, '|', chr(92) || '|')")} FROM t UNION ALL SELECT {_GRID.format("area, n")} FROM (SELECT area, count(*) AS n FROM i GROUP BY area))
SELECT 'report' AS file, line, count(*) AS n FROM l GROUP BY line UNION ALL SELECT 'counter', area || ',' || n, 1 FROM (SELECT area, count(*) AS n FROM i GROUP BY area) UNION ALL SELECT 'counter', 'area,n', 1"""


@query("K4 K5 A10 A11 O1", _REPORT_SQL)
def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a report and of a counter that are written about the issues of pages; empty lines of the report left out."""
    found = page_issues(table(spark, sf_dir, "pages"))
    summary = profile.summary(found, issues=F.count("*"), grave=F.count_if(rank() <= 1))
    by_area = found.groupBy("area").agg(F.count("*").alias("n"))
    said = sinks.report("Audit", summary.orderBy(F.desc("indicator")), ranked(found).select("severity", "issue_type", "url").limit(20), by_area.orderBy(F.desc("n"), "area"), ("Start with the worst.",))
    folder = f"{shared_dir(spark)}/florilege/report-{uuid.uuid4().hex}"
    spark.createDataFrame([(said,)], "value string").coalesce(1).write.text(f"{folder}/report")
    sinks.csv_counts(by_area, f"{folder}/areas", [F.desc("n"), "area"])
    lines = lambda name: spark.read.text(f"{folder}/{name}").where("value <> ''").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))
    return lines("report").select(F.lit("report").alias("file"), "line", "n").unionByName(lines("areas").select(F.lit("counter").alias("file"), "line", "n"))
