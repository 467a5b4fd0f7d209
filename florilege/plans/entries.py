"""Dictionary entries: rules, validity, lemmas. The stand-in makes an entry of each conversation and a sense of each turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.operators import profile
from florilege.registry import query, table
from florilege.rules import entries as rules

_ENTRY = "CASE WHEN conv_id % 13 = 0 THEN '' WHEN conv_id % 7 = 0 THEN 'X-' || conv_id WHEN conv_id % 17 = 0 THEN 'DLP-e_1-0a' ELSE 'DLP-e_1-' || conv_id END"
_SENSE_ID = "CASE WHEN turn % 5 = 4 THEN '' WHEN turn % 7 = 3 THEN 'DLP-z-' || turn ELSE entry_id || '-' || turn END"
_SENSE_N = "CASE WHEN conv_id % 11 = 0 AND turn = 1 THEN 'b' WHEN conv_id % 3 = 0 THEN CAST(turn // 2 AS VARCHAR) ELSE CAST(turn AS VARCHAR) END"


def stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in the shape that the rules take."""
    turns = table(spark, sf_dir, "conversations").withColumn("entry_id", F.expr(_ENTRY))
    defs = F.when(F.col("turn") % 4 == 3, F.array().cast("array<string>")).when(F.col("turn") % 6 == 5, F.array(F.lit("..."))).otherwise(F.array("text"))
    number = F.expr(_SENSE_N.replace("turn // 2", "turn div 2").replace("VARCHAR", "STRING"))
    nested = (F.col("turn") % 8 == 7).cast("int")
    sense = F.struct("turn", F.struct(F.expr(_SENSE_ID).alias("id"), number.alias("n"), defs.alias("defs")).alias("s"))
    # an entry has few senses
    grouped = turns.groupBy("conv_id", "entry_id").agg(F.transform(F.array_sort(F.collect_list(sense)), lambda x: x["s"]).alias("senses"), (F.sum(F.size(defs)) + F.sum(nested)).cast("int").alias("all_defs"))
    text_id = F.col("conv_id").cast("string")
    shown = F.col("conv_id") % 10 != 0
    ids = F.concat(F.array("entry_id"), F.when(shown, F.transform("senses", lambda s: s["id"])).otherwise(F.array().cast("array<string>")))
    return grouped.select(
        F.filter(ids, lambda i: i != "").alias("ids"),
        "all_defs",
        "entry_id",
        F.when(F.col("conv_id") % 9 == 0, "only").otherwise("yes").alias("volp"),
        F.when(F.col("conv_id") % 8 == 0, F.array(F.lit(""))).otherwise(F.array(F.concat(F.lit("Lema"), (F.col("conv_id") % 60).cast("string")))).alias("orths"),
        F.when(F.col("conv_id") % 10 == 0, F.array().cast("array<struct<id:string,n:string,defs:array<string>>>")).otherwise(F.col("senses")).alias("senses"),
        F.array(F.concat(F.when(F.col("conv_id") % 4 == 0, " lema").otherwise("LEMA"), (F.col("conv_id") % 90).cast("string"))).alias("refs"),
        F.array(F.when(F.col("conv_id") % 6 == 0, F.lit("90/02/2016")).otherwise(F.lit("3/4/2017"))).alias("dates"),
        F.array(F.when(F.col("conv_id") % 15 == 0, F.lit("???")).otherwise(F.concat(F.lit("s."), F.left(text_id, F.lit(1))))).alias("grams"),
    )


_CTES = rf"""WITH t AS (SELECT conv_id, turn, {_ENTRY} AS entry_id, text FROM conversations),
e AS (SELECT DISTINCT conv_id, entry_id, conv_id % 9 = 0 AS volp_only, CASE WHEN conv_id % 8 = 0 THEN '' ELSE 'Lema' || conv_id % 60 END AS orth, CASE WHEN conv_id % 4 = 0 THEN ' lema' ELSE 'LEMA' END || conv_id % 90 AS ref, CASE WHEN conv_id % 6 = 0 THEN '90/02/2016' ELSE '3/4/2017' END AS dated FROM t),
s AS (SELECT conv_id, turn, entry_id, {_SENSE_ID} AS id, {_SENSE_N} AS n, CASE WHEN turn % 4 = 3 THEN 0 ELSE 1 END AS defs, CASE WHEN turn % 8 = 7 THEN 1 ELSE 0 END AS nested, turn % 4 <> 3 AND (turn % 6 = 5 OR regexp_matches(text, '^\s*(\[\s*\.\.\.\s*\]|\.\.\.|\?{{2,}})\s*$')) AS held FROM t WHERE conv_id % 10 <> 0),
g AS (SELECT conv_id, any_value(entry_id) AS entry_id, count(*) AS k, sum(defs) + sum(nested) AS d, min(defs) AS every, bool_or(n = 'b') AS odd, list(TRY_CAST(n AS INT) ORDER BY turn) FILTER (n <> 'b') AS num FROM s GROUP BY conv_id),
x AS (SELECT entry_id, entry_id AS id FROM e WHERE entry_id <> '' UNION ALL SELECT entry_id, id FROM s WHERE id <> ''),
i AS (SELECT 'entrada_sem_xml_id' AS rule, entry_id, orth AS evidence FROM e WHERE entry_id = ''
UNION ALL SELECT 'xml_id_fora_do_padrao_proposto', entry_id, id FROM x WHERE NOT regexp_matches(id, '^DLP-\S+_\d+-[a-z0-9]+(-\d+)*$')
UNION ALL SELECT 'entrada_sem_lema', entry_id, '' FROM e WHERE orth = ''
UNION ALL SELECT 'volp_only_com_sentidos', g.entry_id, CAST(k AS VARCHAR) FROM g JOIN e USING (conv_id) WHERE volp_only
UNION ALL SELECT 'dlp_sem_sentidos', entry_id, '' FROM e WHERE NOT volp_only AND conv_id % 10 = 0
UNION ALL SELECT 'entrada_com_sentidos_sem_definicao', entry_id, CAST(k AS VARCHAR) FROM g WHERE d = 0
UNION ALL SELECT 'numeracao_de_sentidos_suspeita', entry_id, array_to_string(num, ',') FROM g WHERE len(num) <> len(list_distinct(num)) OR list_sort(num) <> num
UNION ALL SELECT 'numero_de_sentido_nao_inteiro', entry_id, n FROM s WHERE n = 'b'
UNION ALL SELECT 'sentido_sem_xml_id', entry_id, n FROM s WHERE id = ''
UNION ALL SELECT 'id_de_sentido_nao_derivado_da_entrada', entry_id, id FROM s WHERE id <> '' AND entry_id <> '' AND NOT starts_with(id, entry_id || '-')
UNION ALL SELECT 'sentido_sem_definicao', entry_id, id FROM s WHERE defs = 0
UNION ALL SELECT 'sentido_com_definicao_placeholder', entry_id, id FROM s WHERE held
UNION ALL SELECT 'data_nao_reconhecida', entry_id, dated FROM e WHERE conv_id % 6 = 0
UNION ALL SELECT 'referencia_com_espacos', entry_id, ref FROM e WHERE ref LIKE ' %'
UNION ALL SELECT 'classe_gramatical_desconhecida', entry_id, '???' FROM e WHERE conv_id % 15 = 0
UNION ALL SELECT 'xml_id_duplicado', id, CAST(r AS VARCHAR) FROM (SELECT id, row_number() OVER (PARTITION BY id) AS r FROM x) WHERE r > 1
UNION ALL SELECT 'referencia_sem_lema_exato', entry_id, ref FROM e WHERE lower(trim(ref)) NOT IN (SELECT lower(orth) FROM e))"""


@query("Q19 Q20 Q21 Q22 Q23 Q24 Q25 Q26 Q27 Q28 Q29 Q30 Q31 Q32 Q33 Q34 Q35 A14 F15 F16 J7 J8 X36 A20 W3", f"{_CTES} SELECT rule, count(*) AS n FROM i GROUP BY rule")
def entry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.frequencies(rules.issues(stand_in(spark, sf_dir)), "rule")


@query("A14 W2", f"{_CTES} SELECT entry_id, rule, evidence, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY entry_id, evidence) AS ordinal FROM i) WHERE ordinal <= 25")
def entry_rule_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.first_n(rules.issues(stand_in(spark, sf_dir)), ["rule"], ["entry_id", "evidence"], 25)


@query("Q37 A5 A6 P1", f"""{_CTES}, v AS (SELECT CASE WHEN volp_only THEN 'VOLP' ELSE 'DLP' END AS kind, NOT (e.entry_id = '' OR orth = '' OR coalesce(odd, false) OR conv_id % 6 = 0 OR conv_id % 15 = 0 OR coalesce(every, 1) = 0) AS valid FROM e LEFT JOIN g USING (conv_id))
SELECT kind, valid, count(*) AS n, CAST(GROUPING(kind, valid) AS BIGINT) AS level FROM v GROUP BY GROUPING SETS ((), (kind), (valid), (kind, valid))""")
def entry_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.by_sets(rules.validated(stand_in(spark, sf_dir)).select("kind", "valid"), "kind", "valid")


@query("A13 X19", "WITH e AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 8 <> 0) SELECT 'lema' || conv_id % 60 AS lemma, count(*) AS n FROM e GROUP BY 1 HAVING count(*) > 1")
def lemma_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.lemma_groups(stand_in(spark, sf_dir)).select("lemma", "n")


@query("Q36 A1 F15", "SELECT lang, count(*) FILTER (coalesce(text, '') = '') AS empty, count(*) FILTER (regexp_matches(text, '^\\s*(\\[\\s*\\.\\.\\.\\s*\\]|\\.\\.\\.|\\?{2,})\\s*$')) AS placeholders FROM documents GROUP BY lang")
def empties_and_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty"), F.count_if(rules.is_placeholder(F.col("text"))).alias("placeholders"))
