"""A planned data set against a live one: what to create, add, leave; what is missing or differs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_plan(plan: DataFrame, live: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, action): created, augmented (the plan fills what the live row leaves empty), or unchanged.

    Additive: live values are never cleared or overwritten, so a second run finds everything unchanged. A key that is live
    several times is ambiguous.
    """
    seen = live.groupBy(key).agg(F.count("*").alias("_copies"), *[F.max(c).alias(f"_{c}") for c in columns])
    gain = F.lit(False)
    for c in columns:
        gain = gain | (F.col(f"_{c}").isNull() & F.col(c).isNotNull())
    action = F.when(F.col("_copies").isNull(), "created").when(F.col("_copies") > 1, "ambiguous").when(gain, "augmented").otherwise("unchanged")
    return plan.join(seen, key, "left").select(key, action.alias("action"))


def apply_plan(plan: DataFrame, live: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The live rows after the plan: gaps filled, new keys added."""
    planned = plan.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return live.select(key, *columns).join(planned, key, "full").select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in columns])


def missing_claims(plan: DataFrame, live: DataFrame, columns: list[str]) -> DataFrame:
    """Claims of the plan that aren't live, as often as they are missing."""
    return plan.select(*columns).exceptAll(live.select(*columns))


def classified(plan: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """(state, n): plan keys that are missing, duplicate or matched among the live ones."""
    copies = live.groupBy(key).agg(F.count("*").alias("_copies"))
    state = F.when(F.col("_copies").isNull(), "missing").when(F.col("_copies") > 1, "duplicate").otherwise("matched")
    return plan.join(copies, key, "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def resolved_references(claims: DataFrame, ids: DataFrame) -> DataFrame:
    """claims (subject, value) whose value '@key' names another record, with ids (key, id): target is null where none is known."""
    named = claims.withColumn("key", F.when(F.col("value").startswith("@"), F.substring("value", 2, 2**31 - 1)))
    return named.join(ids.withColumnRenamed("id", "target"), "key", "left")


def property_ids(plan: DataFrame, live: DataFrame) -> DataFrame:
    """plan (key, label, datatype) against live properties (id, label, datatype): key, id, and missing or datatype as problem.

    Of live properties with one label the first by id counts.
    """
    known = live.groupBy("label").agg(F.min(F.struct("id", F.col("datatype").alias("live_datatype"))).alias("p")).select("label", "p.id", "p.live_datatype")
    problem = F.when(F.col("id").isNull(), "missing").when(~F.col("datatype").eqNullSafe(F.col("live_datatype")), "datatype")
    return plan.join(known, "label", "left").select("key", "id", problem.alias("problem"))


def missing_sources(plan: DataFrame, live: DataFrame) -> DataFrame:
    """Claims (subject, signature) of plan with a source that are live, none of whose live references (sources) names it."""
    named = live.groupBy("subject", "signature").agg(F.flatten(F.collect_list("sources")).alias("named"))  # a claim has few references
    return plan.where("source IS NOT NULL").join(named, ["subject", "signature"]).where(~F.array_contains("named", F.col("source"))).select("subject", "signature", "source")


def image_differences(manifest: DataFrame, kept: DataFrame) -> DataFrame:
    """(parent, position, problem) of images (parent, position, hash) that are missing, not in the manifest, or other ones."""
    both = manifest.withColumn("wanted", F.lit(True)).join(kept.select("parent", "position", F.col("hash").alias("kept_hash"), F.lit(True).alias("there")), ["parent", "position"], "full")
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("wanted").isNull(), "unknown").when(~F.col("hash").eqNullSafe(F.col("kept_hash")), "hash")
    return both.select("parent", "position", problem.alias("problem")).where("problem IS NOT NULL")


def by_position(rows: DataFrame, key: str, cells: str, properties: tuple[str | None, ...]) -> DataFrame:
    """(key, property, value) of the filled cells of rows whose columns stand for properties; None skips a column."""
    pairs = [F.struct(F.lit(p).alias("property"), F.get(cells, k).alias("value")) for k, p in enumerate(properties) if p]
    found = rows.select(key, F.explode(F.array(*pairs)).alias("x")).select(key, "x.property", F.trim("x.value").alias("value"))
    return found.where(F.coalesce("value", F.lit("")) != "")


def field_differences(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field) for each column in which matched rows differ, nulls equal."""
    other = right.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    both = left.select(key, *columns).join(other, key)
    fields = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns]))
    return both.select(key, F.explode(fields).alias("field"))


def count_differences(expected: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys whose counts n differ, absent ones as 0."""
    a, b = expected.select(key, F.col("n").alias("expected")), current.select(key, F.col("n").alias("current"))
    both = a.join(b, key, "full").select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("current", F.lit(0)).alias("current"))
    return both.where("expected <> current")


def stale(plan: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Plan rows made from an older revision than the live one."""
    return plan.join(live.select(key, F.col("revision").alias("live_revision")), key).where("revision < live_revision")


def replace_block(page, begin: str, end: str, text):
    """A page (column) with what stands between two marker lines replaced."""
    import re

    return F.regexp_replace(page, f"(?s){re.escape(begin)}.*?{re.escape(end)}", F.concat(F.lit(begin + "\n"), text, F.lit("\n" + end)))
