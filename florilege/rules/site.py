"""Rules over pages with type, title, slug and parsed sizes; each gives issue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions import text
from florilege.rules.issues import issue, row

HEAVY_CHARS, FEW_WORDS, LONG_SLUG, LEAST_OVERLAP, LEAST_TITLE_TOKENS = 300_000, 5, 130, 0.35, 4

#: Substrings that are typos, with what was meant.
TYPOS = (("liberdadade", "liberdade"), ("portigues", "portugues/portugueses"), ("despois", "depois"), ("docuemtno", "documento"), ("competa", "completa"), ("contéudos", "conteúdos"), ("conteudos", "conteúdos"), ("orgão", "órgão"))


def overlap(title: Column, slug: Column) -> Column:
    """The share of a title's words that the slug has."""
    own = text.slug_tokens(title)
    return F.size(F.array_intersect(own, text.slug_tokens(slug))) / F.greatest(F.lit(1), F.size(own))


def typos_in(*fields: Column, typos: tuple = TYPOS) -> Column:
    """A reason for each typo that the fields hold."""
    blob = F.lower(F.concat_ws(" ", *fields))
    return F.array_compact(F.array(*[F.when(F.contains(blob, F.lit(bad)), F.lit(f"erro provável: {bad} -> {good}")) for bad, good in typos]))


def slug_reasons(longest: int = LONG_SLUG, typos: tuple = TYPOS) -> Column:
    """What is odd about a page's title and slug."""
    share = overlap(F.col("title"), F.col("slug"))
    low = (share < LEAST_OVERLAP) & (F.size(text.slug_tokens(F.col("title"))) >= LEAST_TITLE_TOKENS)
    first = F.array_compact(F.array(F.when(F.length("slug") > longest, F.lit("slug muito longo")), F.when(low, F.concat(F.lit("baixo alinhamento título/slug ("), text.percent(share), F.lit(")")))))
    return F.concat(first, typos_in(text.strip_html(F.col("title")), F.col("slug"), typos=typos))


def page_rules(pages: DataFrame, most: int = HEAVY_CHARS, fewest: int = FEW_WORDS, longest: int = LONG_SLUG, typos: tuple = TYPOS) -> DataFrame:
    """Issues of single pages (url, html, type, title, slug), all from one pass over them."""
    size = F.length("html")
    words = text.word_count(text.strip_html(F.col("html")))
    # each page's text is stripped once, and only where the cheaper conditions hold
    empty = (F.col("type") == "post") & (size > 0) & ~F.col("html").rlike(r"(?i)<img\b")
    pages = pages.select("url", "type", size.alias("size"), F.when(empty, words).alias("words"), slug_reasons(longest, typos).alias("reasons"))
    found = F.array(
        F.when((F.col("type") == "page") & (F.col("size") > most), row("Técnico", "Alta", "Página muito pesada", F.col("url"), F.concat(F.col("size").cast("string"), F.lit(" caracteres de HTML")), "Dividir ou paginar o conteúdo")),
        F.when(F.col("words") < fewest, row("Conteúdo", "Baixa", "Post quase vazio", F.col("url"), F.concat(F.col("words").cast("string"), F.lit(" palavras")), "Completar ou despublicar")),
        F.when(F.size("reasons") > 0, row("Normalização", "Média", "Título/slug suspeito", F.col("url"), F.array_join("reasons", "; "), "Rever título e slug")),
    )
    return pages.select(F.explode(F.array_compact(found)).alias("i")).select("i.*")


def duplicate_titles(pages: DataFrame) -> DataFrame:
    keyed = pages.select("url", "title", text.norm_text(F.col("title")).alias("key")).where("key <> ''")
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("url").alias("url"), F.min("title").alias("title")).where("n > 1")
    return issue(groups, "Conteúdo", "Média", "Títulos duplicados", F.col("url"), F.concat_ws(": ", "key", F.col("n").cast("string")), "Distinguir ou fundir")


def equivalent_categories(terms: DataFrame) -> DataFrame:
    """terms (name, url): names that are equal once folded."""
    groups = terms.select(text.norm_text(F.col("name")).alias("key"), "url").groupBy("key").agg(F.count("*").alias("n"), F.min("url").alias("url")).where("n > 1 AND key <> ''")
    return issue(groups, "Taxonomia", "Alta", "Categorias equivalentes", F.col("url"), F.concat_ws(": ", "key", F.col("n").cast("string")), "Fundir categorias")


def unused_categories(terms: DataFrame, typos: tuple = TYPOS) -> DataFrame:
    """terms (name, url, slug, count, parent, parent_known): empty ones, ones whose parent is unknown, and misspelt ones."""
    wrong = typos_in(F.col("name"), F.col("slug"), typos=typos)
    first = F.array_compact(F.array(F.when(F.col("count") == 0, F.lit("categoria sem posts")), F.when((F.col("parent") != 0) & F.col("parent_known").isNull(), F.lit("parent inexistente na API"))))
    bad = terms.select("*", F.concat(first, wrong).alias("problems"), (F.size(wrong) > 0).alias("misspelt")).where(F.size("problems") > 0)
    severity = F.when((F.col("count") == 0) | F.col("misspelt"), "Média").otherwise("Baixa")
    return issue(bad, "Taxonomia", severity, "Categoria a rever", F.col("url"), F.concat_ws(": ", "name", F.array_join("problems", "; ")), "Rever categoria")


def tables_to_review(tables: DataFrame) -> DataFrame:
    """tables (name, notes, records, reference): noted for review, empty, or without a reference."""
    notes = F.coalesce(F.col("notes"), F.lit(""))
    problems = F.array_compact(
        F.array(
            F.when(F.contains(notes, F.lit("Analisar")), F.lit("marcada para analisar")),
            F.when(F.contains(notes, F.lit("Vazia")) | (F.coalesce(F.col("records"), F.lit(0)) == 0), F.lit("sem registos/vazia")),
            F.when(F.coalesce(F.col("reference"), F.lit("")) == "", F.lit("sem referência")),
        )
    )
    bad = tables.withColumn("problems", problems).where(F.size("problems") > 0)
    return issue(bad, "TablePress", "Média", "Tabela a rever", F.lit(""), F.concat_ws(": ", "name", F.array_join("problems", "; ")), "Rever a tabela")


def residual_tags(totals: DataFrame) -> DataFrame:
    """totals (tags, categories, url)."""
    return issue(totals.where("tags < 100 AND categories > 1000"), "Taxonomia", "Alta", "Uso residual de tags", F.col("url"), F.concat_ws("/", F.col("tags").cast("string"), F.col("categories").cast("string")), "Adotar ou abandonar as tags")


def outside_sitemap(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Pages that the sitemap (url) lacks; nothing if it is empty."""
    filled = sitemap.limit(1).select(F.lit(True).alias("filled"))
    lost = pages.select("url").distinct().join(sitemap.select("url"), "url", "left_anti").crossJoin(F.broadcast(filled))
    return issue(lost, "SEO", "Média", "URLs fora do sitemap", F.col("url"), F.col("url"), "Acrescentar ao sitemap")


def broken_links(checked: DataFrame) -> DataFrame:
    """checked (url, status, error)."""
    bad = checked.where("error IS NOT NULL OR status >= 400")
    return issue(bad, "Técnico", "Alta", "Link com problema", F.col("url"), F.coalesce("error", F.col("status").cast("string")), "Corrigir ou remover")


def writing(texts: DataFrame) -> DataFrame:
    """texts (url, text): one row per warning."""
    found = texts.select("url", F.explode(text.quality_warnings(F.col("text"))).alias("warning"))
    return issue(found, "Texto", F.when(F.col("warning").isin("encoding", "repeated word"), "Alta").otherwise("Média"), "Escrita", F.col("url"), F.col("warning"), "Rever o texto")
