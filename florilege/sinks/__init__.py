"""What is written: JSON, CSV, sheets, reports, plans with digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHEET_ROWS = 10_000


def json_lines(df: DataFrame, path: str, sort: list[str] | None = None) -> None:
    """One JSON object per row, letters as they are, nulls kept."""
    df = df.orderBy(*sort) if sort else df
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def csv_counts(df: DataFrame, path: str, order: list) -> None:
    """A counter: header and rows in total order, in one file. Counters are small; long tables are written by other sinks."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def csv_checked(df: DataFrame, path: str) -> DataFrame:
    """Write CSV, read it again and fail unless every row came back."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("nullValue", "\\N").csv(path)
    again = df.sparkSession.read.schema(df.schema).option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").option("nullValue", "\\N").csv(path)
    if df.exceptAll(again).count() or again.exceptAll(df).count():
        raise ValueError(f"{path} reads back differently")
    return again


def sheets(tables: dict[str, DataFrame], folder: str, capped: tuple[str, ...] = (), rows: int = SHEET_ROWS) -> None:
    """A folder of named tables; those that are replaced leave the others alone. Sheets named in capped keep their first rows."""
    for name, df in tables.items():
        df = df.orderBy(*df.columns).limit(rows) if name in capped else df
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def report(title: str, summary: DataFrame, top: DataFrame, by_area: DataFrame, advice: tuple[str, ...] = ()) -> str:
    """A Markdown report from three small tables."""

    def grid(df: DataFrame, most: int) -> list[str]:
        cell = lambda v: str(v).replace("|", "\\|")
        rows = df.limit(most).collect()
        return ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]]

    parts = [f"# {title}", "", *grid(summary, 50), "", "## Main issues", "", *grid(top, 20), "", "## By area", "", *grid(by_area, 50)]
    return "\n".join([*parts, *(["", "## Advice", "", *[f"- {a}" for a in advice]] if advice else [])]) + "\n"


def plan(df: DataFrame, path: str, inputs: DataFrame) -> None:
    """An import plan as JSON, and beside it the digests (path, bytes, sha256) of what it was made from."""
    json_lines(df, f"{path}/plan")
    json_lines(inputs, f"{path}/inputs")


def wiki_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): a wiki table's row per row, signs escaped."""
    from florilege.functions.text import escape_wiki

    return rows.select(F.concat(F.lit("| "), F.concat_ws(" || ", *[escape_wiki(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])).alias("line"))
