"""Documents: words, typos, repeated words, similar terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions import hashing, text
from florilege.operators import dedup, patterns as patterns_, profile, similarity
from florilege.operators.stored import stored
from florilege.plans import sqltext as q
from florilege.registry import query, table
from florilege.rules import terms, writing

#: Typos and spelling pairs of the stand-in corpus, as a person would supply them.
CORPUS_TYPOS = (("ereand", "and"), ("thth", "the"), ("ouou", "ou"), ("pathetic", "poor"), ("enen", "en"))
CORPUS_SPELLINGS = (("that", "this"), ("with", "from"), ("ration", "ation"), ("avec", "con"))


def _values(pairs: tuple) -> str:
    return "(VALUES " + ", ".join(f"({q.quoted(a)}, {q.quoted(b)})" for a, b in pairs) + ")"


def tokens(docs: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, word): folded words of so many letters, as often as they stand in the text."""
    words = F.filter(F.split(text.fold_latin(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda w: F.length(w) >= least)
    return docs.select("doc_id", F.explode(words).alias("word"))


_TOKENS_SQL = f"w AS (SELECT doc_id, unnest(list_filter(string_split_regex({q.fold("coalesce(text, '')")}, '[^a-z]+'), lambda x: len(x) >= 3)) AS word FROM documents)"


@query("A8 F13 O2 X47", f"""WITH {_TOKENS_SQL}, c AS (SELECT word, count(*) AS n FROM w WHERE word NOT IN {q.STOP} GROUP BY word), e AS (SELECT word, doc_id, row_number() OVER (PARTITION BY word ORDER BY doc_id) AS r FROM (SELECT DISTINCT word, doc_id FROM w))
SELECT c.word, n, (SELECT string_agg(CAST(doc_id AS VARCHAR), ' | ' ORDER BY r) FROM e WHERE e.word = c.word AND r <= 3) AS examples FROM c WHERE n >= 2""")
def word_counts_with_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens(table(spark, sf_dir, "documents")).where(~F.col("word").isin(*text.STOPWORDS))
    return profile.with_examples(words, ["word"], ["doc_id"], 3).where("n >= 2")


@query("J2 F10 Q3 Q5 X12", f"SELECT doc_id, wrong, \"right\" FROM documents, {_values(CORPUS_TYPOS)} AS t(wrong, \"right\") WHERE contains(lower(coalesce(text, '')), wrong)")
def typo_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.createDataFrame(CORPUS_TYPOS, "wrong string, right string")
    return patterns_.holding(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", patterns).select("doc_id", "wrong", "right")


#: Letters that folding leaves alone; they would count as no letters in the SQL.
_FOLDED_SQL = lambda x: f"replace({q.fold(x)}, 'ß', 's')"
_MANY_SQL = f"""WITH w AS (SELECT string_split_regex({_FOLDED_SQL("coalesce(text, '')")}, '[^a-z]+') AS w FROM benchmark),
p AS (SELECT DISTINCT wrong FROM (SELECT unnest(list_filter(w, lambda x: len(x) >= 3)) AS wrong FROM w UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: CASE WHEN len(w[i]) > 0 AND len(w[i + 1]) > 0 THEN w[i] || ' ' || w[i + 1] END)) FROM w) WHERE wrong IS NOT NULL),
r AS MATERIALIZED (SELECT '\\b(?:' || string_agg(wrong, '|' ORDER BY len(wrong) DESC, wrong) || ')\\b' AS r FROM p)
SELECT wrong, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_FOLDED_SQL("coalesce(text, '')")}, r)) AS wrong FROM documents, r) GROUP BY wrong"""


@query("J2 X12 Q17", _MANY_SQL)
def many_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the words and pairs of words of all benchmark items stand in documents as whole words, pairs before words."""
    folded = lambda c: F.replace(text.fold_latin(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("s"))
    words = table(spark, sf_dir, "benchmark").select(F.split(folded(F.col("text")), "[^a-z]+").alias("w"))
    pair = lambda a, b: F.when((a != "") & (b != ""), F.concat(a, F.lit(" "), b))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), pair)
    wanted = words.select(F.explode(F.concat(F.filter("w", lambda x: F.length(x) >= 3), F.array_compact(pairs))).alias("wrong")).distinct()
    texts = table(spark, sf_dir, "documents").select(folded(F.col("text")).alias("text"))
    found = patterns_.whole_words_in_passes(texts, "text", wanted.withColumn("right", F.lit(None).cast("string")), keep=[])
    return profile.frequencies(found, "wrong")


@query("J1 X4 F11 U4", f"""SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]{{4,}}')) AS word FROM benchmark) b WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]{{4,}}')) AS k FROM documents) d WHERE d.k = b.word)""")
def dictionary_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda name: table(spark, sf_dir, name).select(F.explode(text.raw_words(F.col("text"))).alias("word"))
    return similarity.missing_words(words("benchmark").distinct(), [words("documents")])


_HAS = " OR ".join(f"word = '{w}'" for pair in CORPUS_SPELLINGS for w in pair)


@query("J3 Q8", f"""WITH d AS MATERIALIZED (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex({q.fold("coalesce(text, '')")}, '[^a-z]+')) AS word FROM documents) WHERE {_HAS}) SELECT older, newer FROM {_values(CORPUS_SPELLINGS)} AS p(older, newer) JOIN d AS a ON a.word = older JOIN d AS b ON b.word = newer""")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame(CORPUS_SPELLINGS, "older string, newer string")
    known = tokens(table(spark, sf_dir, "documents")).join(F.broadcast(pairs.select(F.explode(F.array("older", "newer")).alias("word"))), "word", "left_semi").select("word").distinct()
    return pairs.join(known.withColumnRenamed("word", "older"), "older", "left_semi").join(known.withColumnRenamed("word", "newer"), "newer", "left_semi").select("older", "newer")


@query("J5 W7 X5 F11 Q9")
def similar_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all documents; too slow in SQL, tests hold it against brute force."""
    return similarity.similar_terms(profile.frequencies(tokens(table(spark, sf_dir, "documents")).withColumnRenamed("word", "term"), "term"))


def _benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return tokens(items).withColumnRenamed("word", "term")


_PICKED_SQL = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT term, item_id FROM (SELECT item_id, unnest(list_filter(string_split_regex({q.fold("coalesce(text, '')")}, '[^a-z]+'), lambda x: len(x) >= 3)) AS term FROM benchmark)),
c AS MATERIALIZED (SELECT term, count(*) AS n, row_number() OVER (ORDER BY count(*), term) AS k FROM w GROUP BY term HAVING len(term) BETWEEN 5 AND 24 AND count(*) <= 20),
x AS MATERIALIZED (SELECT term, string_agg(CAST(item_id AS VARCHAR), ' | ' ORDER BY item_id) FILTER (r <= 2) AS examples FROM (SELECT term, item_id, row_number() OVER (PARTITION BY term ORDER BY item_id) AS r FROM (SELECT DISTINCT term, item_id FROM w)) GROUP BY term),
e AS MATERIALIZED (SELECT a.k, a.term, a.n, b.term AS other, b.n AS other_n, levenshtein(a.term, b.term) AS distance FROM c AS a JOIN c AS b ON left(a.term, 2) = left(b.term, 2) AND a.term <> b.term WHERE levenshtein(a.term, b.term) <= 2 AND greatest(a.n, b.n) >= 2 AND (len(a.term) >= 8 OR levenshtein(a.term, b.term) = 1)),
g AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY k) AS step FROM (SELECT DISTINCT term, k FROM e)),
p(step, pick, seen) AS (SELECT 0::BIGINT, NULL::STRUCT(term VARCHAR, n BIGINT, other VARCHAR, other_n BIGINT, distance BIGINT), []::VARCHAR[] UNION ALL
  SELECT step, pick, CASE WHEN pick IS NULL THEN seen ELSE list_append(seen, pick.other || '|' || pick.term) END FROM
  (SELECT p.step + 1 AS step, p.seen, arg_min({{'term': e.term, 'n': e.n, 'other': e.other, 'other_n': e.other_n, 'distance': e.distance}}, {{'d': e.distance, 'g': -abs(e.n - e.other_n), 'o': e.other}}) FILTER (NOT list_contains(p.seen, e.term || '|' || e.other)) AS pick FROM p JOIN g ON g.step = p.step + 1 JOIN e ON e.term = g.term GROUP BY ALL)),
f AS (SELECT unnest(pick) FROM p WHERE pick IS NOT NULL)
SELECT 'Normalização' AS area, 'Média' AS severity, 'Termos muito semelhantes no corpus' AS issue_type, '' AS url,
left(format('Termos muito próximos no corpus: ''{{}}'' ({{}} ocorrências) e ''{{}}'' ({{}} ocorrências), distância {{}}. Exemplos ''{{}}'': {{}}. Exemplos ''{{}}'': {{}}.', f.term, n, other, other_n, distance, f.term, a.examples, other, b.examples), 500) AS evidence,
format('Confirmar se ''{{}}'' e ''{{}}'' são grafias distintas legítimas ou erro/variante a normalizar.', f.term, other) AS recommendation FROM f JOIN x AS a ON a.term = f.term JOIN x AS b ON b.term = f.other"""


@query("J5 W7 X5 Q9 Q14 A8", _PICKED_SQL)
def near_term_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues about the terms of benchmark items that are nearly alike, with the items that hold them first."""
    words = _benchmark_terms(spark, sf_dir)
    shown = profile.with_examples(words, ["term"], ["doc_id"], 2)
    return terms.near_terms(similarity.similar_terms(profile.frequencies(words, "term")), shown)


#: DuckDB counts bytes, so letters of two bytes are replaced by capitals and digits, which lower-case words don't have.
_ONE_BYTE = lambda x: f"translate({x}, '{''.join(map(chr, range(0xDF, 0x100)))}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456')"
_STEPS = f"levenshtein({_ONE_BYTE('w.word')}, {_ONE_BYTE('k.word')})"
_CORRECTED_SQL = f"""WITH {{known}}, w AS (SELECT word, min(item_id) AS item_id FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]{{{{4,}}}}')) AS word FROM benchmark) WHERE len(word) >= 5 AND word = lower(word) AND word NOT IN {q.STOP} GROUP BY word),
n AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT doc_id, lower(word) AS word FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]{{{{4,}}}}')) AS word FROM documents)) GROUP BY word),
c AS (SELECT w.word, item_id, arg_min(k.word, {{{{'d': {_STEPS}, 'n': -n.n, 'k': k.word}}}}) AS correction FROM w JOIN k ON abs(len(w.word) - len(k.word)) <= 2 JOIN n ON n.word = k.word WHERE w.word NOT IN (SELECT word FROM k) AND {_STEPS} BETWEEN 1 AND 2 GROUP BY w.word, item_id)
SELECT 'Normalização' AS area, 'Média' AS severity, 'Erro ortográfico provável (dicionário PT)' AS issue_type, CAST(item_id AS VARCHAR) AS url, format('No campo Corpo, ''{{{{}}}}'' não consta do dicionário português; sugestão automática: ''{{{{}}}}''.', word, correction) AS evidence, correction AS recommendation FROM c"""


@query("X10", r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1] AND len(w[i]) >= 3 AND w[i] NOT IN ('que', 'the', 'and', 'para'))) AS BIGINT) AS n FROM t""")
def repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.repeated_words(F.coalesce("text", F.lit("")))).cast("long").alias("n"))


_TRIPLES = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")


@query("X6 X11 Q3 Q14 Q16", f"""SELECT doc_id, regexp_matches(text, '�|Ã[\\x{{80}}-\\x{{bf}}]') AS encoding, regexp_matches(text, '\\s{{2,}}') AS double_space, regexp_matches(text, '!!|\\?\\?|\\.\\.|,,|;;|::') AS punctuation,
len(text) - len(replace(text, '(', '')) <> len(text) - len(replace(text, ')', '')) OR len(text) - len(replace(text, '[', '')) <> len(text) - len(replace(text, ']', '')) AS brackets,
regexp_matches(text, '<[^>]+>|&lt;|&gt;') AS markup, regexp_matches({q.norm_text("text")}, '{_TRIPLES}') AS tripled FROM documents WHERE text IS NOT NULL""")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.quality_warnings(F.col("text")).alias("w"))
    names = {"encoding": "encoding", "double space": "double_space", "repeated punctuation": "punctuation", "unbalanced brackets": "brackets", "visible markup": "markup", "tripled letter": "tripled"}
    return found.select("doc_id", *[F.array_contains("w", k).alias(v) for k, v in names.items()])


@query("U6 A12 X38", "SELECT sha256('=' || text) AS digest, count(*) AS n, count(*) - 1 AS extra FROM documents GROUP BY 1 HAVING count(*) > 1")
def multiset_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.repeated(table(spark, sf_dir, "documents").select(hashing.digest(F.col("text")).alias("digest")), "digest")


@query("W1 M2 X38", "WITH d AS (SELECT doc_id, left(sha256('=' || text), 24) AS k FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS nth FROM d) SELECT doc_id, CASE WHEN nth = 1 THEN k ELSE k || ':duplicate:' || nth END AS key FROM n")
def row_identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.identities(table(spark, sf_dir, "documents"), hashing.digest(F.col("text")), F.col("doc_id")).select("doc_id", "key")


@query("X9 X8 X20", r"""SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\n+'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g')) <> '')) AS BIGINT) AS lines, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS BIGINT) AS words,
trim(regexp_replace(substr(text, greatest(100 - 95, 0) + 1, 100 + 95 - greatest(100 - 95, 0)), '\s+', ' ', 'g')) AS around FROM documents WHERE text IS NOT NULL""")
def document_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split("text", r"\n+"), lambda p: text.compact(p) != "")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(lines).cast("long").alias("lines"), text.word_count(F.col("text")).alias("words"), text.excerpt(F.col("text"), F.lit(100)).alias("around"))


_PARAGRAPHS = r"list_filter(list_transform(string_split_regex(regexp_replace({}, '([.!?])[\s\x{{a0}}]+', '\1' || chr(1), 'g'), '[\x01\n]+'), lambda p: trim(regexp_replace(p, '[\s\x{{a0}}]+', ' ', 'g'))), lambda p: p <> '')"


@query("X9", f"SELECT doc_id, CAST(len({_PARAGRAPHS.format("coalesce(text, '')")}) AS BIGINT) AS paragraphs FROM documents")
def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.paragraphs(F.coalesce("text", F.lit("")))).cast("long").alias("paragraphs"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xE0, 0x100)))
_DOUBLES = "|".join(f"{c}{c}+" for c in _LETTERS)
_KNOWN_SQL = """k AS MATERIALIZED (SELECT word FROM (SELECT DISTINCT doc_id, lower(word) AS word FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]{4,}')) AS word FROM documents)) GROUP BY word HAVING count(*) >= 10)"""


def known_words(docs: DataFrame, counted: bool = False) -> DataFrame:
    """A stand-in for dictionaries: lower-cased words that ten documents or more use, and if wanted how many (n)."""
    words = docs.select("doc_id", F.explode(F.array_distinct(F.transform(text.raw_words(F.col("text")), lambda w: F.lower(w)))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 10").select("word", *["n"] * counted)


@query("X7 X13 J1", f"""WITH {_KNOWN_SQL}, w AS (SELECT raw AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]{{4,}}')) AS raw FROM documents) WHERE regexp_matches(raw, '{_DOUBLES}') AND lower(left(raw, 1)) = left(raw, 1) AND NOT regexp_matches(raw, '^[ivxlcdmIVXLCDM]+$') AND lower(raw) NOT IN (SELECT word FROM k) GROUP BY raw),
r AS (SELECT word, n, unnest(range(1, len(regexp_extract_all(word, '{_DOUBLES}')) + 1)) AS i, regexp_extract_all(word, '{_DOUBLES}') AS runs, string_split_regex(word, '{_DOUBLES}') AS rest FROM w WHERE word = lower(word)),
f AS (SELECT DISTINCT word, n, array_to_string(list_transform(range(1, len(rest) + 1), lambda j: rest[j] || CASE WHEN j = i THEN repeat(left(runs[j], 1), m) WHEN j <= len(runs) THEN runs[j] ELSE '' END), '') AS meant FROM r, (VALUES (1), (2)) AS t(m))
SELECT f.word, meant, n FROM f JOIN k ON k.word = meant""")
def doubled_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-case words with a doubled letter that aren't known, where a form with one run shortened is: (word, meant, n)."""
    docs = table(spark, sf_dir, "documents")
    known = stored(known_words(docs), "known")
    words = docs.select(F.explode(text.raw_words(F.col("text"))).alias("word")).where(F.col("word").rlike(r"([a-zà-ÿ])\1") & ~text.is_capitalised(F.col("word")) & (F.lower("word") == F.col("word")) & ~F.col("word").rlike("^[ivxlcdm]+$"))
    odd = words.groupBy("word").agg(F.count("*").alias("n")).join(known, "word", "left_anti")
    forms = odd.select("word", "n", F.explode(text.collapsed(F.col("word"))).alias("meant"))
    return forms.join(known.withColumnRenamed("word", "meant"), "meant", "left_semi").select("word", "meant", "n")


#: What people keep for the stand-in corpus.
CORPUS_CURATED = writing.Curated(repeated=("de", "of", "la", "der", "que", "los", "was"), right=("ciónn",), better=(("theea", "thea"),), typos=CORPUS_TYPOS)

_AUDIT_SQL = rf"""WITH p AS (SELECT DISTINCT doc_id, unnest({_PARAGRAPHS.format("text")}) AS p FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, p, string_split(p, ' ') AS c FROM p),
t AS (SELECT doc_id, unnest(list_transform(range(1, len(c)), lambda i: [regexp_extract(c[i], '(?:^|[^\p{{L}}\p{{N}}_])([A-Za-zÀ-ÖØ-öø-ÿ]{{3,}})$', 1), regexp_extract(c[i + 1], '^[\p{{L}}\p{{N}}_]+'), CASE WHEN i > 1 THEN regexp_extract(c[i - 1], '(?:^|[^\p{{L}}\p{{N}}_])([A-Za-zÀ-ÖØ-öø-ÿ]{{3,}})$', 1) ELSE '' END])) AS w FROM c),
r AS (SELECT doc_id, 'Palavra repetida consecutivamente' AS kind, lower(w[1]) AS term FROM t WHERE w[1] <> '' AND w[1] = w[2] AND lower(w[3]) <> lower(w[1]) AND w[1] IN ({', '.join(f"'{x}'" for x in CORPUS_CURATED.repeated)}) AND w[1] NOT IN ('que', 'the', 'and', 'para')),
e AS (SELECT doc_id, 'Possível problema de codificação' AS kind, '' AS term FROM p WHERE regexp_matches(p, '�|Ã[\x{{80}}-\x{{bf}}]')),
y AS (SELECT doc_id, 'Erro conhecido recuperado' AS kind, lower(w) AS term FROM (SELECT doc_id, unnest(regexp_extract_all(p, '[\p{{L}}\p{{N}}_]+')) AS w FROM p) WHERE lower(w) IN ({', '.join(f"'{a}'" for a, _ in CORPUS_TYPOS)})),
{_KNOWN_SQL},
w AS MATERIALIZED (SELECT DISTINCT doc_id, lower(raw) AS term FROM (SELECT doc_id, unnest(regexp_extract_all(p, '[A-Za-zÀ-ÖØ-öø-ÿ]{{4,}}')) AS raw FROM p) WHERE regexp_matches(lower(raw), '{_DOUBLES}') AND lower(left(raw, 1)) = left(raw, 1) AND NOT regexp_matches(raw, '^[ivxlcdmIVXLCDM]+$') AND lower(raw) NOT IN (SELECT word FROM k)),
g AS (SELECT DISTINCT term, unnest(range(1, len(regexp_extract_all(term, '{_DOUBLES}')) + 1)) AS i, regexp_extract_all(term, '{_DOUBLES}') AS runs, string_split_regex(term, '{_DOUBLES}') AS rest FROM w),
f AS (SELECT DISTINCT term FROM (SELECT term, array_to_string(list_transform(range(1, len(rest) + 1), lambda j: rest[j] || CASE WHEN j = i THEN repeat(left(runs[j], 1), m) WHEN j <= len(runs) THEN runs[j] ELSE '' END), '') AS meant FROM g, (VALUES (1), (2)) AS t(m)) JOIN k ON k.word = meant),
d AS (SELECT doc_id, 'Letra repetida indevidamente' AS kind, term FROM w JOIN f USING (term) WHERE term NOT IN ({', '.join(f"'{x}'" for x in CORPUS_CURATED.right)}))
SELECT DISTINCT doc_id, kind, term FROM (FROM r UNION ALL FROM e UNION ALL FROM y UNION ALL FROM d)"""


@query("F14 Q15 Q16 Q17 Q18 X10 X11 X12 X13", _AUDIT_SQL)
def text_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned suspicions in the texts of documents: (doc_id, kind, term), terms lower-cased."""
    docs = table(spark, sf_dir, "documents")
    texts = docs.select(F.col("doc_id").cast("string").alias("url"), F.lit("Corpo").alias("field"), "text")
    found = writing.audit(texts, stored(known_words(docs), "known"), CORPUS_CURATED)
    return found.select(F.col("url").cast("long").alias("doc_id"), "kind", F.lower("term").alias("term")).distinct()


@query("Q6 X5 Q14 J1 F11", _CORRECTED_SQL.format(known=_KNOWN_SQL))
def spelling_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues about lower-case words of benchmark items that aren't known, with their closest known word."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.raw_words(F.col("text"))).alias("word")).where(text.is_spelling_candidate(F.col("word")) & (F.lower("word") == F.col("word")))
    known = stored(known_words(table(spark, sf_dir, "documents"), counted=True), "known")
    unknown = stored(words.groupBy("word").agg(F.min("item_id").alias("item_id")).join(known, "word", "left_anti"), "unknown")
    found = similarity.corrections(unknown, known).join(unknown, "word")
    return terms.corrections(found, F.lit("Corpo"), F.col("item_id").cast("string"))


@query("X21", "SELECT p_partkey, regexp_matches(p_brand, '[0-9]') AS digit, upper(p_type) = p_type AS capitals, regexp_matches(p_name, '^[A-Z]') AS capitalised FROM part")
def word_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").rlike("[0-9]").alias("digit"), (F.upper("p_type") == F.col("p_type")).alias("capitals"), text.is_capitalised(F.col("p_name")).alias("capitalised"))


@query("Q6 X5")
def spelling_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of three documents or more that no dictionary has, with their closest known word; tests hold it against brute force."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.explode(F.array_distinct(text.raw_words(F.col("text")))).alias("word")).where(text.is_spelling_candidate(F.col("word")) & (F.lower("word") == F.col("word")))
    counted = stored(words.groupBy("word").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")), "words")
    unknown = counted.where("n BETWEEN 3 AND 9")
    return similarity.corrections(unknown, counted.where("n >= 10")).join(unknown.select("word", "doc_id"), "word").select("word", "correction", "distance", "doc_id")


@query("X21 X13", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]{4,}')) AS word FROM documents) WHERE regexp_matches(word, '(?i)^m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$') GROUP BY word")
def roman_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(text.raw_words(F.col("text"))).alias("word"))
    return profile.frequencies(words.where(text.is_roman(F.col("word"))), "word")


@query("X4 F13 A8", f"SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(string_split({q.norm_text(q.title())}, ' '), lambda t: len(t) >= 4 AND t NOT IN {q.STOP} AND NOT regexp_matches(t, '^[0-9]+$'))) AS token FROM pages) GROUP BY token")
def title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "pages").select(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"))
    return profile.frequencies(titles.select(F.explode(text.token_list(F.col("title"))).alias("token")), "token")


@query("O4 O5 F11", f"""WITH c AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]{{4,}}')) AS word FROM documents) GROUP BY word)
SELECT word, n FROM c WHERE len(word) >= 5 AND lower(word) NOT IN {q.STOP} AND NOT regexp_matches(word, '[0-9]') AND NOT (upper(left(word, 1)) = left(word, 1) AND lower(left(word, 1)) <> left(word, 1)) ORDER BY n, word LIMIT 1500""")
def spelling_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(text.raw_words(F.col("text"))).alias("word")).where(text.is_spelling_candidate(F.col("word")))
    return profile.frequencies(words, "word").orderBy("n", "word").limit(1500)


@query("X3 X19", f"""SELECT DISTINCT word, {q.fold("word")} AS folded, replace(lower(word), 'ß', 'ss') AS casefolded FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]{{4,}}')) AS word FROM documents)""")
def folded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents with what exact folding makes of them."""
    words = table(spark, sf_dir, "documents").select(F.explode(text.raw_words(F.col("text"))).alias("word")).distinct()
    return words.select("word", text.norm_word(F.col("word"), exact=True).alias("folded"), text.casefold(F.col("word")).alias("casefolded"))


_LISTS = ("lang = 'en'", "lang = 'de'", "lang = 'fr'", "lang = 'es'", "source = 'src0'", "source LIKE 'src1%'")
_WORDS_OF = lambda t: f"SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]{{4,}}')) AS word FROM {t}"
_MASK_SQL = f"""WITH b AS (SELECT DISTINCT word FROM ({_WORDS_OF('benchmark')})), {', '.join(f"d{k} AS MATERIALIZED (SELECT DISTINCT word FROM ({_WORDS_OF('documents')} WHERE {where}))" for k, where in enumerate(_LISTS))}
SELECT word, CAST({' + '.join(f"CASE WHEN word IN (SELECT word FROM d{k}) THEN {1 << k} ELSE 0 END" for k in range(len(_LISTS)))} AS BIGINT) AS mask FROM b"""


@query("J1 U4", _MASK_SQL)
def dictionary_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of six word lists, cut from documents by language and source, hold each word of benchmark items."""
    docs = table(spark, sf_dir, "documents")
    words = lambda df: df.select(F.explode(text.raw_words(F.col("text"))).alias("word"))
    return similarity.membership(words(table(spark, sf_dir, "benchmark")).distinct(), {where: words(docs.where(where)) for where in _LISTS})
