"""Issue rows and their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severities from the worst on; others come after these.
SEVERITIES = ("Crítica", "Alta", "Média", "Baixa")
EVIDENCE_CHARS = 500


def issue(df: DataFrame, area: str, severity: str | Column, kind: str, url: Column, evidence: Column, recommendation: str | Column) -> DataFrame:
    recommendation = F.lit(recommendation) if isinstance(recommendation, str) else recommendation
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(area).alias("area"), severity.alias("severity"), F.lit(kind).alias("issue_type"), url.alias("url"), F.left(evidence.cast("string"), F.lit(EVIDENCE_CHARS)).alias("evidence"), recommendation.alias("recommendation"))


def row(area: str, severity: str, kind: str, url: Column, evidence: Column, recommendation: str) -> Column:
    """An issue as a struct, for rules that are read off a row together."""
    return F.struct(F.lit(area).alias("area"), F.lit(severity).alias("severity"), F.lit(kind).alias("issue_type"), url.alias("url"), F.left(evidence.cast("string"), F.lit(EVIDENCE_CHARS)).alias("evidence"), F.lit(recommendation).alias("recommendation"))


def combined(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def rank() -> Column:
    order = F.when(F.lit(False), 0)
    for k, name in enumerate(SEVERITIES):
        order = order.when(F.col("severity") == name, k)
    return order.otherwise(9)


def ranked(issues: DataFrame) -> DataFrame:
    """The worst first, then by area, type and address."""
    return issues.orderBy(rank(), "area", "issue_type", "url", "evidence")


def without_repeats(issues: DataFrame) -> DataFrame:
    """One row per address, type and start of evidence."""
    return issues.dropDuplicates(["url", "issue_type", "evidence"])
