"""Types of the records that sources give."""

from pyspark.sql import DataFrame

RENDERED = "struct<rendered:string>"
CMS_ITEM = f"id long, date string, modified string, slug string, link string, title {RENDERED}, excerpt {RENDERED}, content {RENDERED}, categories array<long>, tags array<long>, status string, type string"
TAXONOMY_TERM = "id long, count long, description string, link string, name string, slug string, parent long, taxonomy string"
TABLE_ROW = "table_id string, row long, cells array<struct<text:string,links:array<string>,images:array<string>>>"
CATALOGUE_ITEM = "key string, collection string, title string, date string, author string, organization string, type string, source string"


class SchemaDrift(ValueError):
    """The source isn't what was agreed."""


def agreed(df: DataFrame, names: list[str]) -> DataFrame:
    """df, if its columns are exactly these in this order; else SchemaDrift."""
    if df.columns != names:
        raise SchemaDrift(f"columns {df.columns}, agreed {names}")
    return df
