"""Checks of dictionary entries; each rule gives (entry_id, rule, evidence) rows.

An entry is (entry_id, volp, orths, senses, refs, dates, grams), and may have ids (every xml:id in it, its own included) and
all_defs (how many definitions it has at any depth): senses are structs (id, n, defs) of the direct senses. Without ids only the
entry's own is checked, without all_defs only direct definitions count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions.dates import parsed_date

#: What a placeholder and a proper identifier look like.
PLACEHOLDER = r"^\s*(?:\[\s*\.\.\.\s*\]|\.\.\.|\?{2,})\s*$"
PROPER_ID = r"^DLP-\S+_\d+-[a-z0-9]+(?:-\d+)*$"

SCHEMA = "entry_id string, volp string, orths array<string>, senses array<struct<id:string,n:string,defs:array<string>>>, refs array<string>, dates array<string>, grams array<string>"
WHOLE = f"{SCHEMA}, ids array<string>, all_defs int"


def is_placeholder(x: Column) -> Column:
    return x.rlike(PLACEHOLDER)


_FOUND = "array<struct<rule:string,evidence:string>>"


def _found(rule: str, evidence: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), evidence.cast("string").alias("evidence"))


def _once(rule: str, holds: Column, evidence: Column) -> Column:
    return F.when(holds, F.array(_found(rule, evidence))).otherwise(F.array().cast(_FOUND))


def _each(rule: str, array: Column | str, holds, evidence=lambda x: x) -> Column:
    return F.transform(F.filter(array, holds), lambda x: _found(rule, evidence(x)))


def whole(entries: DataFrame) -> DataFrame:
    """entries with ids and all_defs."""
    if "ids" not in entries.columns:
        entries = entries.withColumn("ids", F.filter(F.array("entry_id"), lambda i: F.coalesce(i, F.lit("")) != ""))
    if "all_defs" not in entries.columns:
        entries = entries.withColumn("all_defs", F.aggregate("senses", F.lit(0), lambda n, s: n + F.size(s["defs"])))
    return entries


def issues(entries: DataFrame) -> DataFrame:
    """Every rule of one entry, in one pass, and the two that look across entries (repeated ids, references without a lemma)."""
    entries = whole(entries)
    has_id = F.coalesce("entry_id", F.lit("")) != ""
    n_senses = F.size("senses")
    numbers = F.filter(F.transform("senses", lambda s: s["n"].try_cast("int")), lambda n: n.isNotNull())
    given = lambda x: F.coalesce(x, F.lit("")) != ""
    rules = F.concat(
        _once("entrada_sem_xml_id", ~has_id, F.get("orths", 0)),
        _each("xml_id_fora_do_padrao_proposto", "ids", lambda i: ~i.rlike(PROPER_ID)),
        _once("entrada_sem_lema", ~F.exists("orths", lambda x: x != ""), F.lit("")),
        _once("volp_only_com_sentidos", (F.col("volp") == "only") & (n_senses > 0), n_senses),
        _once("dlp_sem_sentidos", (F.coalesce("volp", F.lit("")) != "only") & (n_senses == 0), F.lit("")),
        _once("entrada_com_sentidos_sem_definicao", (n_senses > 0) & (F.col("all_defs") == 0), n_senses),
        _once("numeracao_de_sentidos_suspeita", (F.size("numbers") != F.size(F.array_distinct("numbers"))) | (F.array_sort("numbers") != F.col("numbers")), F.array_join(F.col("numbers").cast("array<string>"), ",")),
        _each("numero_de_sentido_nao_inteiro", "senses", lambda s: given(s["n"]) & s["n"].try_cast("int").isNull(), lambda s: s["n"]),
        _each("sentido_sem_xml_id", "senses", lambda s: ~given(s["id"]), lambda s: s["n"]),
        _each("id_de_sentido_nao_derivado_da_entrada", "senses", lambda s: has_id & given(s["id"]) & ~s["id"].startswith(F.concat(F.col("entry_id"), F.lit("-"))), lambda s: s["id"]),
        _each("sentido_sem_definicao", "senses", lambda s: F.size(s["defs"]) == 0, lambda s: s["id"]),
        _each("sentido_com_definicao_placeholder", "senses", lambda s: (F.size(s["defs"]) > 0) & F.forall(s["defs"], is_placeholder), lambda s: s["id"]),
        _each("data_nao_reconhecida", "dates", lambda d: parsed_date(F.trim(d)).isNull()),
        _each("referencia_com_espacos", "refs", lambda r: r.rlike(r"(?U)^\s|\s$")),
        _each("classe_gramatical_desconhecida", "grams", lambda g: g == "???"),
    )
    single = entries.withColumn("numbers", numbers).select("entry_id", F.explode(rules).alias("x")).select("entry_id", "x.rule", "x.evidence")
    return single.unionByName(repeated_ids(entries)).unionByName(dangling_references(entries))


def repeated_ids(entries: DataFrame) -> DataFrame:
    """A row for each occurrence of an id, of whatever element, after the first."""
    extra = whole(entries).select(F.explode("ids").alias("entry_id")).groupBy("entry_id").agg(F.count("*").alias("n")).where("n > 1")
    return extra.select("entry_id", F.lit("xml_id_duplicado").alias("rule"), F.explode(F.transform(F.sequence(F.lit(2).cast("long"), F.col("n")), lambda k: k.cast("string"))).alias("evidence"))


def dangling_references(entries: DataFrame) -> DataFrame:
    """References whose trimmed text is no lemma, whatever the case."""
    lemmas = entries.select(F.explode(F.transform("orths", F.lower)).alias("lemma")).where("lemma <> ''").distinct()
    refs = entries.select("entry_id", F.explode("refs").alias("evidence")).withColumn("lemma", F.lower(F.regexp_replace("evidence", r"(?U)^\s+|\s+$", ""))).where("lemma <> ''")
    return refs.join(lemmas, "lemma", "left_anti").select("entry_id", F.lit("referencia_sem_lema_exato").alias("rule"), "evidence")


def lemma_groups(entries: DataFrame) -> DataFrame:
    """Lemmas that occur more than once, occurrences counted, with up to ten of their entries."""
    from florilege.operators.profile import with_examples

    rows = entries.select(F.explode(F.transform("orths", F.lower)).alias("lemma"), "entry_id").where("lemma <> ''")
    return with_examples(rows, ["lemma"], ["entry_id"], 10).where("n > 1")


#: A declarative stand-in for a grammar: what an entry must have and what its fields may hold.
GRAMMAR = (
    ("entry without @id", lambda: F.coalesce("entry_id", F.lit("")) == ""),
    ("entry without form/orth", lambda: F.size("orths") == 0),
    ("attribute volp has an unknown value", lambda: ~F.coalesce("volp", F.lit("")).isin("", "only", "yes", "no")),
    ("form/orth is empty", lambda: F.exists("orths", lambda x: x == "")),
    ("sense has an @n that is no number", lambda: F.exists("senses", lambda s: (F.coalesce(s["n"], F.lit("")) != "") & s["n"].try_cast("int").isNull())),
    ("attribute holds no date", lambda: F.exists("dates", lambda d: parsed_date(F.trim(d)).isNull())),
    ("gramGrp has an unknown value", lambda: F.exists("grams", lambda g: g == "???")),
    ("sense without def", lambda: F.exists("senses", lambda s: F.size(s["defs"]) == 0)),
)


def validated(entries: DataFrame) -> DataFrame:
    """(entry_id, lemma, kind, valid, errors) under GRAMMAR."""
    errors = F.array_compact(F.array(*[F.when(fails(), F.lit(message)) for message, fails in GRAMMAR]))
    kind = F.when(F.col("volp") == "only", "VOLP").otherwise("DLP")
    return entries.select("entry_id", F.get("orths", 0).alias("lemma"), kind.alias("kind"), errors.alias("errors")).withColumn("valid", F.size("errors") == 0)
