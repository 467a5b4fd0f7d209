"""Terms that differ by a letter or two."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.operators import near, profile
from florilege.operators.stored import stored


def _keyed(words: DataFrame, word: str, columns: list[str], first: int, twice: Column) -> DataFrame:
    """columns with a hash of each form that a word has without one letter, or two where `twice` holds, from place `first` on,
    and of the word itself. Places are exploded, so forms are made in compiled code; a place behind the end takes nothing away.
    A form may come twice, as pairs that meet under several forms are made distinct anyhow, without a shuffle of all forms."""
    size = F.length(word)
    one = F.explode(F.sequence(F.lit(first), F.greatest(size + 1, F.lit(first)))).alias("i")
    end = F.greatest(size + 1, F.col("i") + 1)
    other = F.explode(F.sequence(F.when(twice, F.col("i") + 1).otherwise(end), end)).alias("j")
    places = words.select(*columns, one).select(*columns, "i", other)
    form = F.concat(F.left(word, F.col("i") - 1), F.substring(word, F.col("i") + 1, F.col("j") - F.col("i") - 1), F.substring(word, F.col("j") + 1, size))
    return places.select(*columns, F.xxhash64(form).alias("form"))


def near_terms(terms: DataFrame, most: int, block: int = near.BLOCK) -> DataFrame:
    """From (term, n, asked, sure): the `most` best partners of each asked term, (term, n, other, other_n, distance). More may come.

    Pairs share the first two letters, differ by 1 or 2 (1 where the first has under 8 letters), and one of both is used twice or
    more. The best is the closest, of these the one furthest from it in use, then the first by name. A partner whose `sure` is the
    term itself is none. Tasks find pairs under hashes of forms and hand on only the best, so neither forms nor pairs are shuffled:
    terms are, once for each block of those that share their first two letters.
    """
    schema = "term string, n long, other string, other_n long, distance long"
    parts = max(4 * terms.sparkSession.sparkContext.defaultParallelism, int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = near.tiles(terms.select("term", "n", "asked", "sure"), block).repartition(parts, "prefix", "low", "high")
    return dealt.groupBy("prefix", "low", "high").applyInPandas(lambda frame: near.best_of_tile(frame, most), schema)


def similar_terms(counts: DataFrame, most: int = 20, wishes: int = 8, block: int = near.BLOCK) -> DataFrame:
    """From (term, n): each rare term with the partner that it picks, (term, n, other, other_n, distance).

    Terms have 5 to 24 letters, no digit and at most `most` uses. They pick in turn, the rarest first, then by name: of near_terms()
    the best, but none that has picked it before, so a pair comes once. The first wish stands where its partner picks later, or
    surely picks another. The others keep `wishes` of their best partners each, those left out that surely pick them. What a term
    picks rests on earlier terms alone, so all pick at once, and again without those that picked them, until nothing changes; terms
    that are left without a wish, though they may have more partners, are asked for 16 times as many. So all partners count, and
    no table goes through the driver: all joins are by shuffle.
    """
    if most >= 1 << 26:
        raise ValueError("uses are compared up to 2 ** 26")
    terms = stored(counts.where(F.length("term").between(5, near.LONGEST) & (F.col("n") <= most) & ~F.col("term").rlike("[0-9]")).select("term", "n"), "terms")
    gap = -F.abs(F.col("n") - F.col("other_n"))
    in_turn = F.struct("n", "term") < F.struct(F.col("other_n").alias("n"), F.col("other").alias("term"))

    def picked(left: DataFrame) -> DataFrame:
        best = F.min(F.struct("distance", gap.alias("gap"), "other", "other_n")).alias("b")
        return left.groupBy("term").agg(F.first("n").alias("n"), best).select("term", "n", "b.other", "b.other_n", "b.distance")

    every = terms.withColumn("asked", F.lit(True)).withColumn("sure", F.lit(None).cast("string"))
    first = stored(picked(near_terms(every, 1, block)).withColumn("later", in_turn), "first")
    theirs = first.select(F.col("term").alias("other"), F.col("other").alias("wish"), F.col("later").alias("wish_later"))
    stands = F.col("later") | F.col("wish").isNull() | (F.col("wish_later") & (F.col("wish") != F.col("term")))
    told = stored(first.join(theirs.hint("merge"), "other", "left").select("term", "n", "other", "other_n", "distance", stands.alias("stands")), "told")
    settled = told.where("stands").drop("stands")
    asked = told.where("NOT stands").select("term")
    known = stored(terms.join(settled.select("term", F.col("other").alias("sure")).hint("merge"), "term", "left"), "known")
    lists = None
    while True:
        marked = known.join(asked.withColumn("asked", F.lit(True)).hint("merge"), "term", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        # of the lists of several tiles the best so many are surely the best of all
        found = profile.first_n(near_terms(marked, wishes, block), ["term"], [F.col("distance"), gap, F.col("other")], wishes).drop("ordinal").withColumn("most", F.lit(wishes))
        lists = stored(found if lists is None else lists.join(asked.hint("merge"), "term", "left_anti").unionByName(found), "lists")
        wished = picks = stored(picked(lists), "picks")
        gone = None
        while True:
            # pairs that an earlier term has picked: the later one may not
            taken = stored(picks.where(in_turn).select(F.col("other").alias("term"), F.col("term").alias("other")), "taken")
            if gone is not None and taken.count() == gone.count() and taken.join(gone.hint("merge"), ["term", "other"], "left_anti").isEmpty():
                break
            gone = taken
            # only terms whose first wish has picked them look for another
            again = stored(wished.join(taken.hint("merge"), ["term", "other"], "left_semi").select("term"), "again").hint("merge")
            free = lists.join(again, "term", "left_semi").join(taken.hint("merge"), ["term", "other"], "left_anti")
            picks = stored(wished.join(again, "term", "left_anti").unionByName(picked(free)), "picks")
        full = lists.groupBy("term").agg(F.count("*").alias("held"), F.first("most").alias("most")).where("held >= most")
        asked = stored(full.join(picks.hint("merge"), "term", "left_anti").select("term"), "asked")
        if asked.isEmpty():
            return settled.unionByName(picks)
        wishes *= 16


def corrections(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """words (word) with the dictionary's (word, n) closest one at a distance of 1 or 2: (word, correction, distance).

    Of words at one distance the most used wins, then the first by name. Words meet under what is left of them without one
    letter or two, so neither list is compared with all of the other.
    """
    words, dictionary = words.select("word"), dictionary.select(F.col("word").alias("correction"), "n")
    asked = _keyed(words, "word", ["word"], 1, F.lit(True))
    known = _keyed(dictionary, "correction", ["correction", "n"], 1, F.lit(True))
    met = stored(asked.join(known, "form").where(F.abs(F.length("word") - F.length("correction")) <= 2).select("word", "correction", "n").distinct(), "met")
    pairs = met.withColumn("distance", F.levenshtein("word", "correction", 2).cast("long"))
    best = pairs.where(F.col("distance").between(1, 2)).groupBy("word").agg(F.min(F.struct("distance", (-F.col("n")).alias("rare"), "correction")).alias("b"))
    return best.select("word", "b.correction", "b.distance")


def membership(words: DataFrame, dictionaries: dict[str, DataFrame], key: str = "word", name: str = "mask") -> DataFrame:
    """words with a mask of the dictionaries (each with a column key) that hold each: the first one is bit 0, and so on up to 62.
    All dictionaries are shuffled together, once, whatever their number; a null word is in none."""
    if len(dictionaries) > 63:
        raise ValueError("a mask holds 63 dictionaries")
    marked = [known.select(F.col(key), F.lit(1 << k).cast("long").alias(name)) for k, known in enumerate(dictionaries.values())]
    masks = reduce(DataFrame.unionByName, marked).groupBy(key).agg(F.bit_or(name).alias(name))
    return words.join(masks, key, "left").select(*[F.col(f"`{c}`") for c in words.columns], F.coalesce(name, F.lit(0).cast("long")).alias(name))


def missing_words(words: DataFrame, dictionaries: list[DataFrame], key: str = "word") -> DataFrame:
    """Words that none of the dictionaries (one column, key) holds, by one look-up in all of them."""
    return words.join(reduce(DataFrame.unionByName, [known.select(key) for known in dictionaries]), key, "left_anti")
