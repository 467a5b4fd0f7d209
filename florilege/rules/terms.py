"""Issues about words of the whole collection: terms that are nearly alike, and words that a dictionary corrects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.rules.issues import issue

#: Kinds of issues and what they say.
NEAR, SPELLING = "Termos muito semelhantes no corpus", "Erro ortográfico provável (dicionário PT)"
NEAR_EVIDENCE = "Termos muito próximos no corpus: '%s' (%d ocorrências) e '%s' (%d ocorrências), distância %d. Exemplos '%s': %s. Exemplos '%s': %s."
NEAR_ADVICE = "Confirmar se '%s' e '%s' são grafias distintas legítimas ou erro/variante a normalizar."
SPELLING_EVIDENCE = "No campo %s, '%s' não consta do dicionário português; sugestão automática: '%s'."


def near_terms(picks: DataFrame, examples: DataFrame) -> DataFrame:
    """Issues of (term, n, other, other_n, distance); examples (term, examples) say where terms stand."""
    shown = examples.select("term", "examples")
    rows = picks.join(shown, "term", "left").join(shown.select(F.col("term").alias("other"), F.col("examples").alias("other_examples")), "other", "left")
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    evidence = F.format_string(NEAR_EVIDENCE, "term", "n", "other", "other_n", "distance", "term", said("examples"), "other", said("other_examples"))
    return issue(rows, "Normalização", "Média", NEAR, F.lit(""), evidence, F.format_string(NEAR_ADVICE, "term", "other"))


def corrections(found: DataFrame, field: Column, url: Column) -> DataFrame:
    """Issues of (word, correction), with the field and the address where the word was met first."""
    return issue(found, "Normalização", "Média", SPELLING, url, F.format_string(SPELLING_EVIDENCE, field, "word", "correction"), F.col("correction"))
