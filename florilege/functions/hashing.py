"""Digests that don't depend on the order of keys."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def digest(*columns: Column, length: int = 64) -> Column:
    """SHA-256 of the values in the given order, nulls and empty texts told apart."""
    marked = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.left(F.sha2(F.concat_ws("\x1f", *marked).cast("binary"), 256), F.lit(length))


def map_digest(values: Column) -> Column:
    """SHA-256 of a map, whatever the order of its entries."""
    entries = F.array_sort(F.map_entries(values))
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("")))), "\x1f").cast("binary"), 256)


def claim_signature(p: Column, kind: Column, value: Column, qualifiers: Column) -> Column:
    """A claim's text: quantity bounds don't matter, qualifiers are sorted."""
    plain = F.when(kind == "quantity", F.regexp_replace(value, r"\s*\[.*\]$", "")).otherwise(value)
    return F.concat_ws("|", p, kind, plain, F.array_join(F.array_sort(F.coalesce(qualifiers, F.array().cast("array<string>"))), ";"))


def canonical_json(nulled: tuple[str, ...] = ()):
    """A function of JSON text: the same value in one form, whatever the order of keys at any depth. Values of the keys in nulled
    become null wherever they stand; whole numbers lose their decimals; lists keep their order. Null stays null, what is no JSON
    becomes null."""

    def walked(x):
        if isinstance(x, dict):
            return {k: None if k in nulled else walked(v) for k, v in x.items()}
        if isinstance(x, list):
            return [walked(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else x

    @F.pandas_udf(StringType())
    def canonical(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            try:
                return json.dumps(walked(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return texts.map(one, na_action="ignore")

    return canonical


#: What a quantity's bounds are called; they don't tell claims apart.
BOUNDS = ("lowerBound", "upperBound")


def canonical_digest(text: Column, nulled: tuple[str, ...] = BOUNDS) -> Column:
    """SHA-256 of a JSON value in its canonical form."""
    return F.sha2(canonical_json(nulled)(text).cast("binary"), 256)
