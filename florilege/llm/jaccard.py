"""N-gram Jaccard join with a token-group matrix.

Documents with equal shingle sets are one class. Rounds of min-hash buckets compare each class with its bucket's leader
and attach it where they link, so similar documents form groups that are connected already. What may link groups is found
by tokens: of a set of n shingles in one global order, a link needs a common one among the first n - ceil(0.75 n) + 1 (its
prefix). The order is by level, which is higher the more frequent a shingle is in the corpus, then by hash. For each group the union of its members' prefixes is
kept; a query class counts its own prefix tokens in that union, and only groups whose count allows a link with some
member's size qualify. A query is held against a qualifying group's leader; if that doesn't link them, the group is opened
for those members whose distance from the leader lets them be near enough (Jaccard distance is a metric). Opened members
are compared by their whole sets. Links are exact; no candidate is dropped.

Defined results: null and empty texts have no shingles and link with nothing; rows with a null doc_id link with nothing and
get a null component_id; repeated rows are equal sets; rows that share a doc_id are documents of their own, whose components
may have the same number; long texts are read whole; the class with the document of smallest id leads, and of classes that share it the one of smaller number; an empty table gives an
empty result; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from florilege.llm.common import chunks, fresh, materialised
from florilege.llm.components import components
from florilege.llm.shingles import minhashes, overlaps, sets, signatures

#: A link: 100 * shared >= PERCENT * union.
PERCENT = 75
ROUNDS = 3
#: A shingle that COUNTED different sets share is counted there, in windows of WINDOW shingles of a task. Those whose counts sum
#: up to FREQUENT have a level, the binary logarithm of what they are above it: the most frequent ones, EXACT at most, by a
#: list, and others by a table of LEVELS slots of a byte, which may take a rare shingle for one of them (where they are more
#: than a quarter of the slots, their threshold is doubled). Levels only order shingles: they cost speed, never links.
COUNTED, WINDOW, FREQUENT, EXACT, LEVELS = 4, 1 << 22, 32, 1 << 20, 1 << 24
#: Where tokens would meet more than DENSE times as often as there are postings, those that meet most get a level and the
#: postings are made anew, PASSES times at most.
DENSE, PASSES = 64, 3
#: Lists of up to this many ids (and a few numbers each) go to every task; longer ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Rows of a token in one component that are held back before they are let through unjudged; that costs speed, never links.
HELD_ROWS = 100_000
#: Members and queries of an opened group that meet in one task (on average).
BLOCK = 128

_DOC = "doc_id long, n long, sig long, keys array<long>, token long, times long"


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few rows; df should be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _often(window: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (token, times) of shingles that are in COUNTED or more sets of a window."""
    code = np.concatenate(window)
    code.sort()
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    times = np.diff(np.append(starts, len(code)))
    starts, times = starts[times >= COUNTED], times[times >= COUNTED]
    m = len(starts)
    none = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([*none, pa.array(code[starts].view(np.int64)), pa.array(times)], names=["doc_id", "n", "sig", "keys", "token", "times"])


def _profile(docs: DataFrame) -> DataFrame:
    """A row per document (n, sig, keys), and rows (token, times) of shingles that texts near each other share."""
    names = ["doc_id", "n", "sig", "keys", "token", "times"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, held, seen = [], 0, set()
        for batch in (part for whole in batches for part in chunks(whole, "text")):
            n = batch.num_rows
            row, code = sets(batch.column(1))
            sig = signatures(row, code, n)
            doc = [batch.column(0), pa.array(np.bincount(row, minlength=n)), pa.array(sig), pa.array(list(minhashes(row, code, n, ROUNDS)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*doc, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
            # equal sets count once
            new = np.zeros(n, bool)
            new[[k for k, x in enumerate(sig.tolist()) if x not in seen and not seen.add(x)]] = True
            window.append(code[new[row]])
            held += len(window[-1])
            if held >= WINDOW:
                yield _often(window)
                window, held, seen = [], 0, set()
        if held:
            yield _often(window)

    return docs.mapInArrow(read, _DOC)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, text) of the wanted classes (cls, rep, times); a text of the class's document with another set is passed over."""

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, "text")):
            row, code = sets(batch.column(1))
            cls = batch.column(0).to_numpy()
            fits = np.flatnonzero(signatures(row, code, batch.num_rows) == cls)
            once = np.sort(fits[np.unique(cls[fits], return_index=True)[1]])
            yield batch.take(pa.array(once))

    found = docs.join(small(wanted.select("cls", "rep")), docs["doc_id"] == wanted["rep"]).select("cls", "text")
    found = found.mapInArrow(same, "cls long, text string")
    if not wanted.where("times > 1").isEmpty():  # documents that are there more than once, in several steps perhaps
        found = found.dropDuplicates(["cls"])
    return materialised(found, "texts")


def judged(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs (x, y) of classes with their Jaccard distance and whether they link, by their whole sets."""
    schema = "x long, y long, distance double, linked boolean"
    if pairs.isEmpty():
        return pairs.sparkSession.createDataFrame([], schema)
    texts = _texts(docs, _wanted(classes, pairs.select("x"), pairs.select("y")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for a in chunks(whole, "a") for b in chunks(a, "b")):
            na, nb, both = overlaps(batch.column(2), batch.column(3))
            union = na + nb - both
            columns = [batch.column(0), batch.column(1), pa.array(1 - both / np.maximum(union, 1)), pa.array(100 * both >= PERCENT * union)]
            yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "distance", "linked"])

    x, y = texts.select(F.col("cls").alias("x"), F.col("text").alias("a")), texts.select(F.col("cls").alias("y"), F.col("text").alias("b"))
    both = pairs.join(x, "x").join(y, "y").select("x", "y", "a", "b")
    return materialised(both.mapInArrow(judge, schema), "judged")


def _wanted(classes: DataFrame, *ids: DataFrame) -> DataFrame:
    """Rows of classes whose number is in one of the one-column ids."""
    every = ids[0].toDF("cls")
    for more in ids[1:]:
        every = every.unionByName(more.toDF("cls"))
    return materialised(classes.join(every.distinct(), "cls").select("cls", "rep", "times"), "wanted")


def matrix_links(frame: pd.DataFrame) -> pd.DataFrame:
    """Queries (side 1) against the token matrix of a block of members (side 0): a linked member for each query that has one."""
    held, asked = frame[frame["side"] == 0], frame[frame["side"] == 1]
    if held.empty or asked.empty:
        return pd.DataFrame({"x": [], "y": []}, dtype="int64")
    row, code = sets(pa.array(held["text"], pa.large_string()))
    tokens, column = np.unique(code, return_inverse=True)
    sizes = np.bincount(row, minlength=len(held))
    starts = np.cumsum(sizes) - sizes
    names, found = held["cls"].to_numpy(), []
    for cls, text in zip(asked["cls"], asked["text"], strict=True):
        own = sets(pa.array([text], pa.large_string()))[1]
        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
        flags = np.zeros(len(tokens), np.int64)
        flags[at[tokens[at] == own]] = 1
        both = np.add.reduceat(flags[column], starts)
        linked = np.flatnonzero(100 * both >= PERCENT * (sizes + len(own) - both))
        if len(linked):  # the group is connected, so one link joins the query to all of it
            found.append((cls, names[linked[0]]))
    return pd.DataFrame(found, columns=["x", "y"]).astype("int64")


def opened_links(queries: DataFrame, members: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (x, y) of queries (x, group) with members (group, y), a block of either side to a task."""
    if queries.isEmpty():
        return queries.select("x", F.col("x").alias("y"))
    sizes = queries.groupBy("group").agg(F.count("*").alias("q")).join(members.groupBy("group").agg(F.count("*").alias("m")), "group")
    parts = materialised(sizes.select("group", F.ceil(F.col("q") / BLOCK).cast("int").alias("qs"), F.ceil(F.col("m") / BLOCK).cast("int").alias("ms")), "blocks")
    members = members.join(parts.select("group"), "group", "left_semi")
    texts = _texts(docs, _wanted(classes, queries.select("x"), members.select("y")))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    asked = queries.select(F.col("x").alias("cls"), "group").join(parts, "group").select("group", part("qs").alias("qb"), upto("ms").alias("mb"), F.lit(1).alias("side"), "cls")
    held = members.select(F.col("y").alias("cls"), "group").join(parts, "group").select("group", upto("qs").alias("qb"), part("ms").alias("mb"), F.lit(0).alias("side"), "cls")
    rows = asked.unionByName(held).join(texts, "cls").select("group", "qb", "mb", "side", "cls", "text")
    return materialised(rows.groupBy("group", "qb", "mb").applyInPandas(matrix_links, "x long, y long"), "opened-links")


class Levels:
    """The level of shingles; their order is by level, then by hash."""

    def __init__(self, tokens: np.ndarray, levels: np.ndarray, table: np.ndarray | None = None):
        self.tokens, self.levels, self.table = tokens, levels, table

    @classmethod
    def of(cls, counted: DataFrame) -> Levels:
        """Of (token, times), with times of FREQUENT or more. Slots are made in blocks, which bound what reaches the driver."""
        level = F.least(F.lit(200), F.floor(F.log2(F.col("times") / FREQUENT)) + 1).cast("int").alias("level")
        listed = _least(counted, FREQUENT, EXACT)
        exact = counted.where(F.col("times") >= listed).select("token", level).toPandas()
        tokens = exact["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(tokens)
        tokens, levels = tokens[order], exact["level"].to_numpy(np.uint8)[order]
        if listed == FREQUENT:
            return cls(tokens, levels)
        others = counted.where(F.col("times") < listed)
        rest = _least(others, FREQUENT, LEVELS // 4)
        bits = LEVELS.bit_length() - 1
        block = min(bits, 16)
        slots = others.where(F.col("times") >= rest).groupBy(F.shiftrightunsigned("token", 64 - bits).alias("slot")).agg(F.max(level).alias("level"))

        def packed(group: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros(1 << block, np.uint8)
            out[group["slot"].to_numpy() & ((1 << block) - 1)] = group["level"]
            return pd.DataFrame({"block": [int(group["slot"].iloc[0]) >> block], "levels": [out.tobytes()]})

        table = np.zeros(1 << bits, np.uint8)
        for r in slots.groupBy(F.shiftright("slot", block).alias("b")).applyInPandas(packed, "block long, levels binary").toLocalIterator():
            table[r["block"] << block : (r["block"] + 1) << block] = np.frombuffer(r["levels"], np.uint8)
        return cls(tokens, levels, table)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code), np.uint8)
        if self.table is not None:
            out = self.table[(code >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)]
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, code), len(self.tokens) - 1)
            out = np.where(self.tokens[at] == code, self.levels[at], out)
        return out


def _least(counted: DataFrame, least: int, most: int) -> int:
    """The threshold, doubled until `most` tokens at most reach it."""
    while counted.where(F.col("times") >= least).limit(most + 1).count() > most:
        least *= 2
    return least


def first_ones(row: np.ndarray, code: np.ndarray, n: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Places of each row's first n - ceil(0.75 n) + 1 shingles by (level, code); rows and codes within them are sorted."""
    most = np.where(n > 0, n - -(-PERCENT * n // 100) + 1, 0)
    starts = np.cumsum(n) - n
    place = np.arange(len(row)) - starts[row]
    take = place < most[row]
    ranked = np.bincount(row, level > 0, len(n)) > 0
    for k in np.flatnonzero(ranked).tolist():
        a, b = int(starts[k]), int(starts[k] + n[k])
        take[a:b] = False
        take[a + np.argsort(level[a:b], kind="stable")[: most[k]]] = True
    return np.flatnonzero(take)


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token (the first column), those whose token is in several components (the fourth)."""
    held, passing = None, None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        token, comp = batch.column(0).to_numpy(), batch.column(3).to_numpy()
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        ends = np.append(starts[1:], len(token))
        mixed = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
        if passing is not None:
            mixed |= token[starts] == passing
        last = int(starts[-1])
        if mixed[-1] or ends[-1] - last > HELD_ROWS:
            mixed[-1], held, passing = True, None, token[-1]
        else:
            held, passing = batch.slice(last), None
        yield batch.filter(pa.array(np.repeat(mixed, ends - starts)))


def _prefixes(docs: DataFrame, levels: Levels) -> DataFrame:
    """(cls, doc_id, n, tokens) for each row of docs that has an id and words: its set and its prefix."""
    known = docs.sparkSession.sparkContext.broadcast(levels)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, "text")):
            row, code = sets(batch.column(1))
            n = np.bincount(row, minlength=batch.num_rows)
            at = first_ones(row, code, n, known.value(code))
            ends = np.append(0, np.cumsum(np.bincount(row[at], minlength=batch.num_rows)))
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[at].view(np.int64)))
            out = pa.RecordBatch.from_arrays([pa.array(signatures(row, code, batch.num_rows)), batch.column(0), pa.array(n), tokens], names=["cls", "doc_id", "n", "tokens"])
            yield out.filter(pa.array(n > 0))

    return docs.where("doc_id IS NOT NULL").mapInArrow(read, "cls long, doc_id long, n long, tokens array<long>")


def _postings(docs: DataFrame, levels: Levels, special: DataFrame, once: bool) -> DataFrame:
    """(token, cls, group, comp, n, weight) of prefixes, for tokens that classes of at least two components have.

    weight: how many classes the component has. special: classes that are not a single document and component of their own; documents of others need no look-up.
    """
    found = _prefixes(docs, levels).join(special, "cls", "left").where("rep IS NULL OR doc_id = rep")
    if not once:
        found = found.dropDuplicates(["cls"])
    found = found.select(F.explode("tokens").alias("token"), "cls", F.coalesce("group", "cls").alias("group"), F.coalesce("comp", "cls").alias("comp"), "n", F.coalesce("weight", F.lit(1)).alias("weight"))
    # every row of a token lies in one partition, sorted, and is streamed through the second function
    return found.repartition("token").sortWithinPartitions("token").mapInArrow(shared, "token long, cls long, group long, comp long, n long, weight long")


def group(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    matched = _matched(docs)
    return matched.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _matched(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n, sig (its set's number), root (its component's number) and component (the smallest doc_id there).

    Both are null where there is nothing to link: without words, and without a doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    profile = materialised(_profile(docs), "profile")
    rows = profile.where("sig IS NOT NULL")
    # a class is a set, numbered by its signature; its document is the one of smallest id (with how many rows)
    copies = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy(F.col("sig").alias("cls"), "doc_id").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("times"))
    classes = copies.groupBy("cls").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.min_by("times", "doc_id").alias("times"), F.sum("times").alias("copies"), F.first("keys").alias("keys"))
    classes = materialised(classes, "classes")

    # similar documents into groups: each class has one leader at most, and its distance from it
    near = f"100 * least(n, m) >= {PERCENT} * greatest(n, m)"
    stars, active = None, classes
    for r in range(ROUNDS):
        keyed = active.select("cls", "n", "rep", F.element_at("keys", r + 1).alias("key"))
        # the smallest document leads: what copies were made from is often older than they are
        leaders = keyed.groupBy("key").agg(F.min(F.struct("rep", "cls", "n")).alias("least"), F.count("*").alias("size")).where("size > 1")
        leaders = leaders.select("key", F.col("least.cls").alias("y"), F.col("least.n").alias("m"))
        leaders = materialised(leaders, "leaders")  # so that a full bucket's rows can be split in the join
        pairs = keyed.join(leaders, "key").where("cls <> y").where(near).select(F.col("cls").alias("x"), "y")
        found = judged(materialised(pairs, "pairs"), docs, classes).where("linked")
        stars = found if stars is None else stars.unionByName(found)
        active = materialised(active.join(found.select(F.col("x").alias("cls")).distinct(), "cls", "left_anti"), "active")
    as_edges = lambda df: df.select(F.col("x").alias("a"), F.col("y").alias("b"))
    # leaders are smaller than what they lead and are led in later rounds only, so ROUNDS steps reach the root, the least of all
    leads = materialised(stars.select(F.col("x").alias("cls"), F.col("y").alias("leader"), "distance"), "leads")
    grouped = classes.join(leads, "cls", "left").select("cls", "n", "rep", "times", "copies", F.coalesce("leader", "cls").alias("group"), F.coalesce("distance", F.lit(0.0)).alias("distance"))
    grouped = grouped.withColumn("comp", F.col("group"))
    for _ in range(ROUNDS - 1):
        up = leads.select(F.col("cls").alias("comp"), F.col("leader").alias("_up"))
        grouped = grouped.join(up, "comp", "left").withColumn("comp", F.coalesce("_up", "comp")).drop("_up")
    grouped = materialised(grouped.select("cls", "n", "rep", "times", "copies", "group", "distance", "comp"), "grouped")

    postings, unions = _indexed(docs, profile, grouped)
    low, high = F.greatest(F.col("least"), F.ceil(F.col("n") * PERCENT / 100)), F.least(F.col("most"), F.floor(F.col("n") * 100 / PERCENT))
    need = lambda m: F.ceil(PERCENT * (F.col("n") + m) / (100 + PERCENT) - F.greatest(F.col("n"), m) * PERCENT / 100 - 1e-6)
    # classes of small components ask, those of large ones are asked by group: so their members don't meet one by one
    asks = "weight < other_weight OR weight = other_weight AND comp > other_comp"
    counts = postings.join(unions, "token").where(asks).groupBy("cls", "n", "other", "least", "most").agg(F.count("*").alias("common"))
    qualified = counts.where(low <= high).where(F.col("common") >= F.greatest(F.lit(1), F.least(need(low), need(high)))).select(F.col("cls").alias("x"), "n", F.col("other").alias("y"))
    qualified = materialised(qualified, "qualified")

    # a query against the group's leader, then against those members that may be near enough
    led = judged(qualified.select("x", "y"), docs, classes)
    farthest = grouped.where("cls <> group").groupBy(F.col("group").alias("y")).agg(F.max("distance").alias("farthest"))
    open_ = led.where("NOT linked").join(farthest, "y").where(F.col("farthest") >= F.col("distance") - (100 - PERCENT) / 100 - 1e-9)
    open_ = materialised(open_.select("x", F.col("y").alias("group"), "distance"), "opened")
    nearest = open_.groupBy("group").agg(F.min("distance").alias("nearest"))
    members = grouped.where("cls <> group").join(nearest, "group").where(F.col("distance") >= F.col("nearest") - (100 - PERCENT) / 100 - 1e-9).select("group", F.col("cls").alias("y"))
    whole = opened_links(open_.select("x", "group"), materialised(members, "members"), docs, classes)
    comp = lambda name: grouped.select(F.col("cls").alias(name), F.col("comp").alias(f"{name}_comp"))
    found = as_edges(led.where("linked")).unionByName(as_edges(whole))
    between = found.join(comp("a"), "a").join(comp("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    final = components(between).withColumnRenamed("id", "comp")
    rooted = materialised(grouped.join(final, "comp", "left").select("cls", "rep", F.coalesce("component_id", "comp").alias("root")), "rooted")
    smallest = materialised(rooted.groupBy("root").agg(F.min("rep").alias("component")), "smallest")
    known = rooted.join(smallest, "root").select("cls", "root", "component")
    return rows.join(known, (rows["sig"] == known["cls"]) & rows["doc_id"].isNotNull(), "left").select("doc_id", "n", "sig", "root", "component")


def _indexed(docs: DataFrame, profile: DataFrame, grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings (token, cls, group, comp, n, weight), and each group's union of them (token, other, other_comp, other_weight, least, most)."""
    counted = profile.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT)
    counted = materialised(counted, "frequent")
    weights = small(materialised(grouped.groupBy("comp").agg(F.count("*").alias("weight")).where("weight > 1"), "weights"))
    special = grouped.where("group <> cls OR comp <> cls OR copies > 1").select("cls", "rep", "group", "comp")
    special = grouped.join(weights, "comp").select("cls", "rep", "group", "comp", "weight").unionByName(special.join(weights, "comp", "left_anti").withColumn("weight", F.lit(1).cast("long")))
    special = small(materialised(special, "special"))
    once = grouped.where("times > 1").isEmpty()
    sizes = grouped.groupBy("group").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    for attempt in range(PASSES):
        postings = materialised(_postings(docs, Levels.of(counted), special, once), "postings")
        unions = materialised(postings.groupBy("token", "group", "comp", "weight").agg(F.count("*").alias("members")), "unions")
        loads = unions.groupBy("token").agg(F.sum("members").alias("members"), (F.sum("members") * F.count("*")).alias("meetings"))
        total = loads.agg(F.sum("members"), F.sum("meetings")).first()
        if attempt == PASSES - 1 or not total[0] or total[1] <= DENSE * total[0]:
            break
        # the order so far let tokens through that meet too often: they get a level by what was counted here
        hot = loads.where((F.col("meetings") > DENSE * F.col("members")) & (F.col("members") >= FREQUENT)).select("token", F.col("members").alias("times"))
        hot = counted.unionByName(hot).groupBy("token").agg(F.max("times").alias("times"))
        before, counted = counted.count(), materialised(hot, "frequent")
        if counted.count() == before:
            break
    unions = unions.join(sizes, "group").select("token", F.col("group").alias("other"), F.col("comp").alias("other_comp"), F.col("weight").alias("other_weight"), "least", "most")
    return postings, unions


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without near duplicates: one document of each component stays.

    That is the one of smallest doc_id; if several sets of a component have this id, the one of smallest number, and if several
    rows have both, the one whose JSON has the smallest digest. Rows that share an id but not a component stay both. Rows with a
    null doc_id and texts without words link with nothing and all stay. Columns may have any name.
    """
    matched = materialised(_matched(docs), "matched")
    own = docs["doc_id"].cast("long")
    if matched.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        # those that go are fewer than those that stay
        gone = materialised(matched.where("doc_id <> component").select(F.col("doc_id").alias("_gone")), "gone")
        return docs.join(small(gone), own == gone["_gone"], "left_anti")
    alone = docs.where(own.isNull())
    one = matched.where("doc_id = component").groupBy("root").agg(F.min(F.struct("doc_id", "sig")).alias("one")).select("one.*")
    kept = materialised(one.unionByName(matched.where("doc_id IS NOT NULL AND component IS NULL").select("doc_id", "sig")).distinct().toDF("_id", "_sig"), "kept")
    name = fresh("_sig", docs.columns)
    at, names = docs.columns.index("text"), [*docs.columns, name]

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, "text")):
            row, code = sets(batch.column(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signatures(row, code, batch.num_rows))], names=names)

    tagged = docs.where(own.isNotNull()).mapInArrow(tag, StructType([*docs.schema.fields, StructField(name, LongType())]))
    found = tagged.join(kept, (tagged["doc_id"].cast("long") == kept["_id"]) & (tagged[name] == kept["_sig"]), "left_semi")
    found = materialised(found, "found")
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    single = found.where(F.col(name) != 0).groupBy(F.col("doc_id").cast("long").alias("_id"), F.col(name).alias("_sig")).agg(F.min_by(every, F.sha2(F.to_json(every), 256)).alias("_row")).select("_row.*")
    return single.unionByName(found.where(F.col(name) == 0).drop(name)).unionByName(alone)


ORACLE_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
r(id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.node = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT id, min(node) AS component_id FROM r GROUP BY id) c ON c.id = s.doc_id"""
