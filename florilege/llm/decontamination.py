"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts become words (runs of letters and digits, lower-cased). A mask looks at some places of a window and ignores the
others; the hashes of what it sees join documents with benchmark items, so a hit survives substitutions at ignored places.
Each mask sees one pair of neighbours, by which it is anchored: the pair is looked up first, and only places whose pair some
item has are hashed by the masks. Document and item are laid side by side as a hit says, and words that agree are counted in
each window of up to WINDOW words: from SHARE of them on, the document is reported. Wherever so many words agree, a mask of
SEED_MASKS (SHORT_MASKS for short items) sees only words that agree, so no such window is missed; a test goes through all
patterns. Items of one to three words have to be there whole, as their share says.

Defined results: null or empty texts match nothing, nor do items without words; items with equal words count as the one with
the smallest item_id; rows that share a doc_id are one document; rows with a null doc_id or item_id are passed over; long texts
are read whole, as one array of hashes each; an agreement of exactly SHARE counts; empty tables give an empty result; only doc_id, item_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import materialised

#: The places looked at, in items of LONG words or more, in shorter ones, and in those of two words and one.
SEED_MASKS = ((0, 1, 2, 4, 5), (0, 1, 6, 8, 9), (0, 5, 9, 10, 11), (0, 1, 3, 7, 11), (0, 1, 2, 4, 7), (0, 1, 3, 4, 6))
SHORT_MASKS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
PAIR_MASKS, WORD_MASKS = ((0, 1),), ((0,),)
LONG = 13
WINDOW, SHARE = 20, 0.7
#: So many seeds of a benchmark go to every task at most; longer lists are joined by shuffle.
BROADCAST_SEEDS = 1_000_000


def masks_of(size: int) -> tuple[tuple[int, ...], ...]:
    """The masks for items of `size` words."""
    return SEED_MASKS if size >= LONG else SHORT_MASKS if size > 2 else PAIR_MASKS if size == 2 else WORD_MASKS


def words(text: Column) -> Column:
    """Hashes of the words of a text."""
    parts = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def _anchored(mask: tuple[int, ...]) -> tuple[int, ...]:
    """A mask's places counted from its first pair of neighbours."""
    first = next((a for a, b in zip(mask, mask[1:], strict=False) if b == a + 1), 0)
    return tuple(k - first for k in mask)


def _seen(mask: tuple[int, ...], at: Column) -> Column:
    """What a mask anchored at `at` sees of h, or null where its window goes beyond an end."""
    number = sum(1 << k for k in mask)
    mask = _anchored(mask)
    return F.when((at + mask[0] >= 0) & (at + mask[-1] < F.size("h")), F.xxhash64(F.lit(number), *[F.get("h", at + k) for k in mask]))


def _places(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row per place of each array h, with the hash of the pair that begins there (of the word alone at the end)."""
    # guarded within the generator: a filter would be pushed below h and split every text twice
    every = F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1))
    places = rows.select(*keep, "h", F.explode(every).alias("place"))
    return places.withColumn("pair", F.xxhash64(F.get("h", F.col("place")), F.get("h", F.col("place") + 1)))


def _seeds(places: DataFrame, masks: tuple[tuple[int, ...], ...], keep: list[str]) -> DataFrame:
    """A row per place and mask: keep, place, mask (its number in masks), seed."""
    seen = F.array(*[_seen(m, F.col("place")) for m in masks])
    return places.select(*keep, "place", F.posexplode(seen).alias("mask", "seed")).where("seed IS NOT NULL")


def _before(masks: tuple[tuple[int, ...], ...]) -> Column:
    """The places of the row's mask, counted from its anchor, and the words of h that it would see one place earlier."""
    places = F.element_at(F.array(*[F.array(*map(F.lit, _anchored(m))) for m in masks]), F.col("mask") + 1)
    return F.struct(places.alias("places"), F.transform(places, lambda k: F.get("h", F.col("place") - 1 + k)).alias("words"))


def find(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, matched, window): documents that hold an item, with the best window's agreeing words and size."""
    items = benchmark.select(F.col("item_id").cast("long"), words(F.col("text")).alias("h")).where(F.col("item_id").isNotNull() & (F.size("h") > 0))
    items = materialised(items.groupBy("h").agg(F.min("item_id").alias("item_id")).select("item_id", "h"), "items")
    masks: tuple[tuple[int, ...], ...] = ()
    seeds = None
    for least, most in ((1, 2), (2, 3), (3, LONG), (LONG, 1 << 31)):  # each class of sizes has masks of its own
        own = items.where((F.size("h") >= least) & (F.size("h") < most))
        if own.isEmpty():
            continue
        found = _seeds(_places(own, ["item_id"]), masks_of(least), ["item_id", "h", "pair"])
        found = found.select("seed", "item_id", F.col("place").alias("item_place"), "pair", (F.col("mask") + len(masks)).alias("item_mask"), _before(masks_of(least)).alias("before"))
        masks += masks_of(least)
        seeds = found if seeds is None else seeds.unionByName(found)
    if seeds is None:
        return docs.select(F.col("doc_id").cast("long"), *[F.lit(0).cast("long").alias(c) for c in ("item_id", "matched", "window")]).where("false")
    seeds = materialised(seeds, "seeds")
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), words(F.col("text")).alias("h"))
    sides = items.select("item_id", F.col("h").alias("item_h"))
    places, keys = _places(rows, ["doc_id"]), seeds.drop("pair")
    alike = F.col("mask") == F.col("item_mask")
    shift = F.col("place") - F.col("item_place")
    if seeds.count() <= broadcast_seeds:
        # places, pairs, masks, both lookups and the check run in one pass over the text, and only hits leave it
        if WORD_MASKS[0] not in masks:  # every mask has a pair
            places = places.join(F.broadcast(seeds.select("pair").distinct()), "pair", "left_semi")
        hits = _seeds(places, masks, ["doc_id", "h"]).join(F.broadcast(keys), "seed").where(alike)
        # of hits at neighbouring places by one mask, which lay document and item side by side the same way, the first is enough;
        # a generator, as a filter would be pushed into the join, whose code for all seeds would no longer be compiled
        earlier = F.zip_with("before.places", "before.words", lambda k, w: F.coalesce(F.get("h", F.col("place") - 1 + k) == w, F.lit(False)))
        hits = hits.select("doc_id", "h", "item_id", F.explode(F.when(~F.forall(earlier, lambda x: x), F.array(shift))).alias("shift"))
        hits = hits.join(F.broadcast(sides), "item_id")
    else:
        found = _seeds(places, masks, ["doc_id"]).join(keys, "seed").where(alike).select("doc_id", "item_id", shift.alias("shift")).distinct()
        hits = found.join(rows, "doc_id").join(sides, "item_id")
    size = F.least(F.lit(WINDOW), F.size("item_h"))
    at = F.greatest(F.lit(0), -F.col("shift"))
    agrees = lambda k: F.get("h", k + F.col("shift")) == F.get("item_h", k)
    # places of the item that lie within the document and agree with it
    same = F.filter(F.sequence(at, F.greatest(at, F.least(F.size("item_h"), F.size("h") - F.col("shift")) - 1)), agrees)
    laid = hits.select("doc_id", "item_id", size.alias("size"), same.alias("same"))
    # a best window may as well begin at an agreeing place: one that would go beyond the item's end counts what its last window does
    counts = F.transform("same", lambda k: F.size(F.filter("same", lambda x: (x >= k) & (x < k + F.col("size")))))
    best = laid.select("doc_id", "item_id", "size", F.array_max(counts).alias("matched"))
    # judged after the aggregate: before it, the condition would be pushed into the join and evaluated there once more
    best = best.groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.max("size").cast("long").alias("window"))
    return best.where(F.col("matched") >= F.ceil(F.col("window") * SHARE - 1e-9))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without documents that hold an item."""
    found = materialised(find(docs, benchmark).select(F.col("doc_id").alias("_found")).distinct(), "contaminated")
    if found.count() <= BROADCAST_SEEDS:
        found = F.broadcast(found)
    return docs.join(found, docs["doc_id"].cast("long") == found["_found"], "left_anti")


#: No masks here: all equal words of a document and an item vote for how the two lie side by side.
ORACLE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS nr, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS h FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS h FROM benchmark WHERE item_id IS NOT NULL),
b AS (SELECT min(item_id) AS item_id, least({WINDOW}, len(h)) AS size, len(h) AS n, h FROM i WHERE len(h) > 0 GROUP BY h),
dw AS (SELECT nr, doc_id, unnest(range(len(h))) AS at, unnest(h) AS w FROM d),
bw AS (SELECT item_id, n, size, unnest(range(n)) AS at, unnest(h) AS w FROM b),
v AS (SELECT doc_id, item_id, n, size, list(bw.at) AS agreeing FROM dw JOIN bw USING (w) GROUP BY nr, doc_id, item_id, n, size, dw.at - bw.at HAVING count(*) >= ceil(size * {SHARE} - 1e-9)),
m AS (SELECT doc_id, item_id, size, list_max(list_transform(range(n - size + 1), lambda s: len(list_filter(agreeing, lambda k: k >= s AND k < s + size)))) AS matched FROM v)
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(max(size) AS BIGINT) AS "window" FROM m WHERE matched >= ceil(size * {SHARE} - 1e-9) GROUP BY doc_id, item_id"""
