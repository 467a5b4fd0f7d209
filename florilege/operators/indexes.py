"""Stored indexes: postings of three letters for substring search, and bitmaps of terms for facets under filters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.operators.catalog import search_words
from florilege.operators.stored import stored

#: Items of a block: 2^16 ids in a row. A list of postings holds at most so many.
BLOCK_BITS = 16
#: Candidates that are looked up by their keys; more are joined.
LOOKED_UP = 1000


# -- substrings


def _grams(word: str) -> list[str]:
    """Three-letter parts that cover a word; none if it is shorter."""
    if len(word) < 3:
        return []
    return [word[k : k + 3] for k in sorted({*range(0, len(word) - 2, 3), len(word) - 3})]


def index_texts(items: DataFrame, key: str, column: str, folder: str) -> None:
    """Write an index of a text column of items below folder: postings (gram, block, ids), sorted by gram so that a look-up opens
    few of them, and the lower-cased texts by block. Keys are longs, each once; null texts have no grams."""
    texts = items.select(F.col(key).cast("long").alias("id"), F.lower(F.coalesce(column, F.lit(""))).alias("text"))
    texts = texts.withColumn("block", F.shiftright("id", BLOCK_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[int]] = {}
        held = 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.string()), pa.array([b for _, b in found], pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["gram", "block", "ids"])

        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for gram in {text[k : k + 3] for k in range(len(text) - 2)}:
                    found.setdefault((gram, number >> BLOCK_BITS), []).append(number)
                    held += 1
                if held > 1_000_000:
                    yield rows()
                    found.clear()
                    held = 0
        if found:
            yield rows()

    texts = stored(texts, "indexed")
    parts = texts.select("id", "text").mapInArrow(run, "gram string, block long, ids array<long>")
    lists = parts.groupBy("gram", "block").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
    lists.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(f"{folder}/postings")
    texts.repartition("block").sortWithinPartitions("block", "id").write.mode("overwrite").partitionBy("block").parquet(f"{folder}/texts")


def candidates(spark: SparkSession, folder: str, words: list[str]) -> DataFrame | None:
    """(block, id) of items that hold the grams of all words; None where no word has any."""
    grams = sorted({g for w in words for g in _grams(w)})
    if not grams:
        return None
    lists = spark.read.parquet(f"{folder}/postings").where(F.col("gram").isin(grams)).groupBy("block").agg(F.array_sort(F.collect_list(F.struct(F.size("ids").alias("n"), "ids"))).alias("lists"))
    # the shortest list first; each is at most a block long
    common = F.aggregate(F.slice("lists", 2, len(grams)), F.get("lists", 0)["ids"], lambda a, b: F.array_intersect(a, b["ids"]))
    return lists.where(F.size("lists") == len(grams)).select("block", F.explode(common).alias("id"))


def search(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """(id) of the indexed items whose text holds each of the first words of a request, whatever the case; signs mean themselves.

    Postings of the words' parts are intersected, and only texts that are left are read. Requests without any word of three
    letters read all texts.
    """
    words = [w.lower() for w in search_words(text)]
    texts = spark.read.parquet(f"{folder}/texts")
    found = candidates(spark, folder, words)
    if found is not None:
        found = stored(found, "candidates")
        blocks = [r["block"] for r in found.select("block").distinct().collect()]  # as many as there are blocks of 2^16 items
        texts = texts.where(F.col("block").isin(blocks)) if blocks else texts.limit(0)
        few = [r["id"] for r in found.select("id").limit(LOOKED_UP + 1).collect()]
        texts = texts.where(F.col("id").isin(few)) if len(few) <= LOOKED_UP else texts.join(found.select("id"), "id", "left_semi")
    for word in words:
        texts = texts.where(F.contains("text", F.lit(word)))
    return texts.select("id")


# -- facets


def term_bitmaps(relations: DataFrame, item: str) -> DataFrame:
    """Of relations (item, taxonomy, term): (taxonomy, term, bucket, bits), where a bucket holds 2^15 items. Items are longs; how
    often one has a term doesn't matter. Bitmaps are built before the shuffle, so a frequent term moves few rows."""
    number = F.col(item).cast("long")
    return relations.where(number.isNotNull()).groupBy("taxonomy", "term", F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def selected(index: DataFrame, filters: dict[str, tuple[str, ...]]) -> DataFrame:
    """(bucket, chosen): items that have one of the terms of each taxonomy of filters."""
    some = [index.where((F.col("taxonomy") == t) & F.col("term").isin(*terms)).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")) for t, terms in filters.items()]
    out = some[0]
    for one in some[1:]:
        out = out.unionByName(one)
    # a bucket that one of the filters lacks has no item
    return out.groupBy("bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("chosen")).where(F.col("n") == len(filters)).select("bucket", "chosen")


def facets_under(index: DataFrame, filters: dict[str, tuple[str, ...]]) -> DataFrame:
    """(taxonomy, term, n): different items of each term among those that filters choose; terms without any are left out."""
    if filters:
        both = index.join(selected(index, filters), "bucket").select("taxonomy", "term", "bucket", F.explode(F.array("bits", "chosen")).alias("bits"))
        index = both.groupBy("taxonomy", "term", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    return index.groupBy("taxonomy", "term").agg(F.sum(F.bitmap_count("bits")).alias("n")).where("n > 0")
