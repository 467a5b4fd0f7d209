"""Terms in tiles: a task compares two blocks of terms that share their first two letters, and hands on each term's best partners."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of a block; a task holds two, and about 50 hashes of forms for each term. Does not affect results.
BLOCK = 1 << 15
#: Pairs that a task compares at a time.
PAIRS = 1 << 19
LONGEST = 24

_WEIGHTS = np.random.default_rng(5).integers(1 << 62, size=LONGEST + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _forms(letters: np.ndarray, twice: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of what is left of terms of one length (a row of code points each) without one letter from the third on and of
    themselves, or without two. Of the places in a run of one letter the first is taken."""
    n, size = letters.shape
    wide = letters.astype(np.uint64)
    total = [np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(wide[:, by:] * _WEIGHTS[: size - by], axis=1, dtype=np.uint64)], axis=1) for by in range(3)]
    part = lambda by, a, b: total[by][:, b - by] - total[by][:, a - by]  # noqa: E731  letters a to b, moved up by so many
    hashes, rows = [], []
    all_rows = np.arange(n, dtype=np.int32)
    if not twice:
        hashes.append(part(0, 0, size))
        rows.append(all_rows)
    for i in range(2, size):
        first = np.ones(n, bool) if i == 2 else letters[:, i] != letters[:, i - 1]
        for j in range(i + 1, size) if twice else (None,):
            kept = np.flatnonzero(first if j is None or j == i + 1 else first & (letters[:, j] != letters[:, j - 1]))
            form = part(0, 0, i) + (part(1, i + 1, size) if j is None else part(1, i + 1, j) + part(2, j + 1, size))
            hashes.append(form[kept])
            rows.append(all_rows[kept])
    return np.concatenate(hashes), np.concatenate(rows)


def _distances(letters: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edits between terms a and b (letters: a column each), whose lengths differ by two at most; 3 stands for more than two."""
    x, y = letters[:, a], letters[:, b]
    gap = (sizes[b] - sizes[a] + 2).astype(np.intp)
    out = np.full(len(a), 3, np.uint8)
    # a band of five diagonals: before[d] is the distance of the first i letters of a and the first i + d - 2 of b
    before = [np.full(len(a), 3, np.uint8), np.full(len(a), 3, np.uint8), *(np.full(len(a), k, np.uint8) for k in range(3))]
    for i in range(1, int(sizes[a].max(initial=0)) + 1):
        row = []
        for d in range(5):
            j = i + d - 2
            if j < 0 or j > LONGEST:
                row.append(np.full(len(a), 3, np.uint8))
                continue
            best = before[d] + (x[i - 1] != y[j - 1]) if j else np.full(len(a), min(i, 3), np.uint8)
            if d < 4:
                best = np.minimum(best, before[d + 1] + np.uint8(1))
            if d:
                best = np.minimum(best, row[d - 1] + np.uint8(1))
            row.append(np.minimum(best, np.uint8(3)))
        before = row
        ends = np.flatnonzero(sizes[a] == i)
        if len(ends):
            out[ends] = np.stack([r[ends] for r in row])[gap[ends], np.arange(len(ends))]
    return out


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """Numbers in order, each once; np.unique hashes them first, which takes longer."""
    numbers = np.sort(numbers)
    return numbers[np.append(True, numbers[1:] != numbers[:-1])] if len(numbers) else numbers


def _meetings(hashes: np.ndarray, rows: np.ndarray, asked: np.ndarray, side: np.ndarray | None):
    """Arrays of pairs of terms that share a form, one of them asked and of two sides if there are such, so many pairs at a time."""
    order = np.argsort(hashes)
    hashes, rows = hashes[order], rows[order]
    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    sizes = np.diff(starts, append=len(hashes))
    held = np.repeat((sizes > 1) & np.logical_or.reduceat(asked[rows], starts), sizes)
    rows, sizes = rows[held], sizes[held[starts]]
    last = np.repeat(np.cumsum(sizes), sizes)
    after = last - np.arange(len(rows)) - 1  # how many with the same form follow
    reached = np.cumsum(after)
    begin = 0
    while begin < len(rows):
        done = reached[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(reached, done + PAIRS, "right")))
        times = after[begin:end]
        one = np.repeat(np.arange(begin, end), times)
        other = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(times) - times, times)
        a, b = rows[one], rows[other]
        held = (a != b) & (asked[a] | asked[b])
        if side is not None:
            held &= side[a] != side[b]
        pairs = _distinct(np.minimum(a, b)[held].astype(np.int64) * len(asked) + np.maximum(a, b)[held])
        if len(pairs):
            yield pairs // len(asked), pairs % len(asked)
        begin = end


def best_of_tile(frame: pd.DataFrame, most: int) -> pd.DataFrame:
    """The `most` best partners of each asked term of a tile (term, n, asked, sure, side); see similarity.near_terms for the order."""
    frame = frame.sort_values("term", ignore_index=True)
    # names are ordered by code points, as Spark orders them
    names, n = frame["term"].to_numpy(object), frame["n"].to_numpy(np.int64)
    asked, count = frame["asked"].to_numpy(bool), len(frame)
    side = frame["side"].to_numpy()
    if frame["low"][0] == frame["high"][0]:
        side = None
    sizes = np.array([len(x) for x in names], np.int64)
    letters = np.array(names, f"<U{LONGEST}").view(np.uint32).reshape(count, LONGEST)
    columns = np.ascontiguousarray(letters.T)
    place = {x: k for k, x in enumerate(names)}
    sure = np.array([place.get(x, -1) for x in frame["sure"].to_numpy(object)], np.int64)
    widest = int(n.max()) + 1
    kept = np.empty(0, np.int64)  # term, distance, gap and name in a number each

    def packed(found: list) -> np.ndarray:
        every = _distinct(np.concatenate(found))
        term = every // (count * 3 * widest)
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        return every[np.arange(len(every)) - np.repeat(starts, np.diff(np.append(starts, len(every)))) < most]

    for twice in (False, True):
        if twice:
            # terms that have enough partners at a distance of one need none at two
            full = np.bincount(kept // (count * 3 * widest), minlength=count) >= most
            asked = asked & (sizes >= 8) & ~full
        if not asked.any():
            break
        forms = []
        for size in np.unique(sizes[sizes >= 6] if twice else sizes):
            at = np.flatnonzero(sizes == size)
            # two letters may go only where one of a pair has eight letters or more, so the other has six or more
            for both in (False, True) if twice else (False,):
                hashes, rows = _forms(letters[at, :size], both)
                forms.append((hashes, at[rows].astype(np.int32)))
        hashes, rows = (np.concatenate(x) for x in zip(*forms, strict=True))
        del forms
        found = [kept]
        for a, b in _meetings(hashes, rows, asked, side):
            used = (np.maximum(n[a], n[b]) >= 2) & (np.abs(sizes[a] - sizes[b]) <= 2)
            a, b = a[used], b[used]
            distance = _distances(columns, sizes, a, b).astype(np.int64)
            for t, o in ((a, b), (b, a)):
                # those at two that meet without one letter meet without two as well
                ok = asked[t] & ((distance == 1) | (distance == 2) & (sizes[t] >= 8) & twice) & (sure[o] != t)
                found.append(((t[ok] * 3 + distance[ok]) * widest + (widest - 1 - np.abs(n[t[ok]] - n[o[ok]]))) * count + o[ok])
            if sum(map(len, found)) > 4 * PAIRS + 2 * len(kept):
                kept = packed(found)
                found = [kept]
        kept = packed(found)
    o, rest = kept % count, kept // count
    t, distance = rest // (3 * widest), rest // widest % 3
    return pd.DataFrame({"term": names[t], "n": n[t], "other": names[o], "other_n": n[o], "distance": distance})


def tiles(terms: DataFrame, block: int = BLOCK) -> DataFrame:
    """terms (term, and more) once for each tile that they are in: prefix, low, high, side. Terms that share their first two letters
    are dealt into blocks of about so many by hash, and every two blocks of them, or a block and itself, are a tile."""
    marked = terms.withColumn("prefix", F.left("term", F.lit(2)))
    blocks = marked.groupBy("prefix").agg(F.ceil(F.count("*") / block).alias("blocks"))
    own = F.pmod(F.xxhash64("term"), "blocks")
    placed = marked.join(blocks.hint("merge"), "prefix").withColumn("own", own)
    dealt = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.select(*terms.columns, "prefix", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), (F.col("own") > F.col("with")).alias("side"))
