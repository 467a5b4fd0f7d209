"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors are one class. Unit vectors are turned into the eigenbasis of their second moments, so that the leading
coordinates hold most of a product. A tree over a bounded sample splits space; its leaves, salted where they are large,
are blocks. Pairs of blocks whose bounding boxes allow the threshold are compared in one task each, tile by tile: leading
dimensions first, the rest bounded by the product of suffix norms, until no pair can reach the threshold. Tasks return a
count per vector and a spanning forest, never all pairs. Vectors of different lengths are compared apart: each length that
has more than a block of vectors as said, all others in one task per length.

Boxes prune what is clustered; vectors that fill space evenly are all compared by their leading dimensions, in a time that grows
with the square of their number.

Defined results: null vectors, zero vectors, and vectors with null or non-finite components link with nothing, as do rows with a
null vec_id (their component_id is null, kept is false); vectors link with those of their own length only; repeated rows are
vectors of their own; a cosine of exactly the threshold is a link; an empty table gives an empty result; only vec_id and embedding
are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from florilege.llm.common import materialised, mix
from florilege.llm.components import components

THRESHOLD = 0.9
#: Vectors of a block at most (on average; small tables make at least BLOCKS blocks of LEAST_BLOCK or more), of a tile, and of
#: the sample that places the tree's cuts. A block of 64 numbers each takes 16 MB; larger ones are sent to fewer tasks.
BLOCK, LEAST_BLOCK, BLOCKS, TILE, SAMPLE = 32_768, 1024, 6, 512, 20_000
#: Leading dimensions that boxes have.
LEAD = 16
#: Dimensions after which tiles are judged again.
STEPS = (16, 32, 64, 128, 256, 512)
#: Where fewer pairs of a tile than this share are left, they go on one by one.
SPARSE = 1 / 16
_EPS = 1e-9


def _moments(vectors: DataFrame, d: int) -> np.ndarray:
    """Sum of outer products of unit vectors; d * d numbers reach the driver."""

    def partial(batches):
        total = np.zeros((d, d))
        for batch in batches:
            x = _unit(_matrix(batch.column(0), d))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], names=["i", "x"])

    out = np.zeros(d * d)
    for r in vectors.select("embedding").mapInArrow(partial, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r["i"]] = r["x"]
    return out.reshape(d, d)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1. A power of two, which rounds nothing, first brings each row's largest component to 0.5 to 1, so that
    squares neither vanish nor overflow."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def grow(x: np.ndarray, leaf: int) -> list[tuple[int, float, int, int]]:
    """A tree over rows x as (dimension, cut, left, right); leaves are (-1, 0, number, 0)."""
    nodes: list[tuple[int, float, int, int]] = []
    leaves = 0

    def split(rows: np.ndarray) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0))
        part = x[rows]
        dim = int((part.max(0) - part.min(0)).argmax()) if len(rows) > leaf else -1
        if dim >= 0:
            cut = float(np.median(part[:, dim]))
            low = part[:, dim] <= cut
            if 0 < low.sum() < len(rows):
                nodes[at] = (dim, cut, split(rows[low]), split(rows[~low]))
                return at
        nodes[at] = (-1, 0.0, leaves, 0)
        leaves += 1
        return at

    split(np.arange(len(x)))
    return nodes


def leaf_of(nodes: list, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        dim, cut, a, b = nodes[at]
        if dim < 0:
            out[rows] = a
        else:
            low = x[rows, dim] <= cut
            todo += [(a, rows[low]), (b, rows[~low])]
    return out


class Forest:
    """Union-find over arrays of pairs; every root is the least of its set."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while True:
            up = self.parent[r]
            if (up == r).all():
                return r
            r = up

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.find(i), self.find(j)
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def linked(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray, threshold: float, steps: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, product) of two tiles that may reach the threshold; sa, sb: suffix norms at each step."""
    rows, cols = np.arange(len(a)), np.arange(len(b))
    product, done, least = np.zeros((len(a), len(b))), 0, threshold - _EPS
    for k, step in enumerate(steps):
        product += a[rows, done:step] @ b[cols, done:step].T
        alive = product >= least - np.outer(sa[rows, k], sb[cols, k])
        done = step
        left = np.count_nonzero(alive)
        if left <= SPARSE * alive.size or k == len(steps) - 1:
            break
        keep_r, keep_c = alive.any(1), alive.any(0)
        if not (keep_r.all() and keep_c.all()):
            rows, cols, product = rows[keep_r], cols[keep_c], product[np.ix_(keep_r, keep_c)]
    i, j = np.nonzero(alive)
    i, j, found = rows[i], cols[j], product[i, j]
    for k, step in list(enumerate(steps))[k + 1 :]:
        if not len(i):
            break
        found = found + (a[i, done:step] * b[j, done:step]).sum(1)
        done = step
        alive = found + sa[i, k] * sb[j, k] >= least
        i, j, found = i[alive], j[alive], found[alive]
    return i, j, found


def compare(frame: pd.DataFrame, basis: np.ndarray, threshold: float, tile: int = TILE) -> pd.DataFrame:
    """Links between the two sides of a block pair (side 0 and 1; only side 0: within it): (kind, a, b).

    kind 0: vector a has b links; kind 1: a and b are connected.
    """
    frame = frame.sort_values("vec_id", ignore_index=True)
    ids, weight, side = frame["vec_id"].to_numpy(), frame["n"].to_numpy(), frame["side"].to_numpy()
    original = _unit(np.array(frame["embedding"].tolist(), np.float64))
    x = original @ basis
    d = x.shape[1]
    steps = [s for s in STEPS if s < d] + [d]
    suffix = np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], 1)[:, ::-1], 0))
    rest = np.stack([suffix[:, s] if s < d else np.zeros(len(x)) for s in steps], 1)
    counts, forest = np.zeros(len(x), np.int64), Forest(len(x))
    within = not (side == 1).any()
    order = [np.flatnonzero(side == s) for s in ((0,) if within else (0, 1))]
    order = [o[np.lexsort((x[o, 1] if d > 1 else x[o, 0], np.round(x[o, 0], 1)))] for o in order]
    tiles = [[o[k : k + tile] for k in range(0, len(o), tile)] for o in order]
    for p, own in enumerate(tiles[0]):
        for other in tiles[0][p:] if within else tiles[1]:
            i, j, product = linked(x[own], x[other], rest[own], rest[other], threshold, steps)
            i, j = own[i], other[j]
            close = np.abs(product - threshold) < 1e-8
            sure = product >= threshold
            if close.any():  # judged by the vectors as they came
                sure[close] = (original[i[close]] * original[j[close]]).sum(1) >= threshold
            if within and other is own:
                sure &= i < j
            i, j = i[sure], j[sure]
            counts += np.bincount(i, weight[j], len(x)).astype(np.int64) + np.bincount(j, weight[i], len(x)).astype(np.int64)
            forest.join(i, j)
    root = forest.find(np.arange(len(x)))
    hit, child = counts > 0, root != np.arange(len(x))
    return pd.DataFrame({"kind": np.r_[np.zeros(hit.sum(), int), np.ones(child.sum(), int)], "a": np.r_[ids[hit], ids[child]], "b": np.r_[counts[hit], ids[root[child]]]})


class Blocks:
    """Which block a vector is in, and which blocks a block is compared with. Its size follows the number of blocks."""

    def __init__(self, sizes: dict[int, int], low: np.ndarray, high: np.ndarray, block: int, threshold: float):
        """sizes: vectors by leaf; low, high: box by leaf."""
        parts = np.array([-(-sizes.get(k, 0) // block) for k in range(len(low))])
        self.first, self.parts = np.cumsum(parts) - parts, np.maximum(parts, 1)
        leaf = np.repeat(np.arange(len(low)), parts)
        self.low, self.high, self.least = low[leaf], high[leaf], threshold - 1e-6

    def of(self, leaf: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.first[leaf] + (mix(ids.astype(np.int64).view(np.uint64)) % self.parts[leaf].astype(np.uint64)).astype(np.int64)

    def partners(self, p: int) -> np.ndarray:
        """Blocks q with a product that can reach the threshold; p is one of them."""
        low, high = self.low[p], self.high[p]
        most = np.maximum.reduce([low * self.low, low * self.high, high * self.low, high * self.high]).sum(1)
        found = most >= self.least
        found[p] = True
        return np.flatnonzero(found)


def _found(classes: DataFrame, d: int, total: int, threshold: float, block: int) -> DataFrame:
    """(kind, a, b), as compare() gives them, for all classes (embedding, rep, n) of vectors of length d."""
    block = min(block, max(LEAST_BLOCK, -(-total // BLOCKS)))
    basis = np.linalg.eigh(_moments(classes, d))[1][:, ::-1].copy()
    sample = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < F.lit(min(1.0, SAMPLE / total) * (1 << 20))).select("embedding").toPandas()["embedding"]
    lead = min(d, LEAD)
    seen = _unit(np.array(sample.tolist(), np.float64).reshape(-1, d)) @ basis
    nodes = grow(seen[:, :lead], max(1, int(block * len(seen) / total))) if len(seen) else [(-1, 0.0, 0, 0)]
    leaves = sum(1 for x in nodes if x[0] < 0)

    def placed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = (_unit(_matrix(batch.column(0), d)) @ basis)[:, :lead]
        return leaf_of(nodes, x), np.c_[x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))]

    def boxes(batches):
        size, low, high = np.zeros(leaves, np.int64), np.full((leaves, lead + 1), np.inf), np.full((leaves, lead + 1), -np.inf)
        for batch in batches:
            leaf, x = placed(batch)
            size += np.bincount(leaf, minlength=leaves)
            np.minimum.at(low, leaf, x)
            np.maximum.at(high, leaf, x)
        some = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(low[some].tolist(), pa.list_(pa.float64())), pa.array(high[some].tolist(), pa.list_(pa.float64()))], names=["leaf", "size", "low", "high"])

    # leaves are few (rows / block, doubled by the tree's rounding), so what the driver sees and every task gets follows rows / block
    edges = [f(F.element_at(c, i + 1)).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(lead + 1)]
    parts = classes.select("embedding").mapInArrow(boxes, "leaf long, size long, low array<double>, high array<double>")
    known = parts.groupBy("leaf").agg(F.sum("size").alias("size"), *edges).collect()
    low, high = np.zeros((leaves, lead + 1)), np.zeros((leaves, lead + 1))
    for r in known:
        low[r["leaf"]], high[r["leaf"]] = [r[f"low{i}"] for i in range(lead + 1)], [r[f"high{i}"] for i in range(lead + 1)]
    blocks = Blocks({r["leaf"]: r["size"] for r in known}, low, high, block, threshold)

    def deal(batches):
        partners: dict[int, np.ndarray] = {}
        for batch in batches:
            own = blocks.of(placed(batch)[0], batch.column(1).to_numpy())
            for p in np.unique(own).tolist():
                if p not in partners:
                    partners[p] = blocks.partners(p)
                rows = batch.filter(pa.array(own == p))
                for q in partners[p].tolist():
                    n = rows.num_rows
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(n, min(p, q))), pa.array(np.full(n, max(p, q))), pa.array(np.full(n, int(p > q), np.int32))], names=["embedding", "vec_id", "n", "p", "q", "side"])

    element = classes.schema["embedding"].dataType.elementType.simpleString()
    dealt = classes.select("embedding", "rep", "n").mapInArrow(deal, f"embedding array<{element}>, vec_id long, n long, p long, q long, side int")
    return materialised(dealt.groupBy("p", "q").applyInPandas(lambda frame: compare(frame, basis, threshold), "kind int, a long, b long"), "links")


def _alone(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """compare() within all vectors of one length, turned into an eigenbasis of their own."""
    x = _unit(np.array(frame["embedding"].tolist(), np.float64))
    return compare(frame.assign(side=0), np.linalg.eigh(x.T @ x)[1][:, ::-1].copy(), threshold)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept."""
    given = vectors.schema["embedding"].dataType
    element = "float" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "double"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    classes = rows.where(usable).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = materialised(classes.withColumn("d", F.size("embedding")), "vectors")
    large = classes.groupBy("d").agg(F.count("*").alias("n")).where(F.col("n") > min(block, LEAST_BLOCK)).orderBy("d").collect()
    small = classes.where(~F.col("d").isin([r["d"] for r in large])) if large else classes
    found = small.select(F.col("rep").alias("vec_id"), "n", "embedding", "d").groupBy("d").applyInPandas(lambda frame: _alone(frame, threshold), "kind int, a long, b long")
    found = materialised(found, "links")
    for r in large:
        found = found.unionByName(_found(classes.where(F.col("d") == r["d"]), r["d"], r["n"], threshold, block))
    links = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    roots = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("id", "rep")
    known = classes.join(links, "rep", "left").join(roots, "rep", "left").select(F.col("embedding").alias("e"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component_id", "rep").alias("component"))
    usable_rows = rows.withColumn("usable", usable)
    joined = usable_rows.join(known, F.col("usable") & (F.col("embedding") == F.col("e")), "left")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"))


ORACLE_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.9 * a.n * b.n),
r(id, node) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.node = l.a)
SELECT id AS vec_id, coalesce((SELECT count(*) FROM l WHERE l.a = id), 0) AS n_links, min(node) AS component_id, id = min(node) AS kept FROM r GROUP BY id"""
