"""Trees as tables of nodes, and XPath's axes as joins.

A node has its place in document order (pre, from 0) and the place of the last node below it (last), so what is below a node is a
range of places, and what follows it is what is behind that range. Rows: key, pre, last, parent (pre of the parent; -1 for a
root), above (the parent's name; empty for a root), depth (1 for a root), name (with the prefix that the document gives its namespace), local, namespace, attributes (by
rendered names), text (the node's own, white space joined).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.operators.ranges import counts_within, pairs_within
from florilege.sources.markup import html_events

NODES = "pre long, last long, parent long, above string, depth int, name string, local string, namespace string, attributes map<string,string>, text string"
_SCHEMA = pa.schema([("pre", pa.int64()), ("last", pa.int64()), ("parent", pa.int64()), ("above", pa.string()), ("depth", pa.int32()), ("name", pa.string()), ("local", pa.string()), ("namespace", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string())])
XML_NAMESPACE = "http://www.w3.org/XML/1998/namespace"
#: Nodes that are handed on at once.
ROWS = 20_000


def numbered(events: Iterator[tuple]) -> Iterator[dict]:
    """Nodes of ("start", name, local, namespace, attributes), ("text", text) and ("end",) events, each when it ends."""
    open_: list[dict] = []
    n = 0
    for event in events:
        if event[0] == "start":
            _, name, local, namespace, attributes = event
            open_.append({"pre": n, "parent": open_[-1]["pre"] if open_ else -1, "above": open_[-1]["name"] if open_ else "", "depth": len(open_) + 1, "name": name, "local": local, "namespace": namespace, "attributes": list(attributes.items()), "text": []})
            n += 1
        elif event[0] == "text":
            if open_:
                open_[-1]["text"].append(event[1])
        else:
            node = open_.pop()
            yield node | {"last": n - 1, "text": " ".join("".join(node["text"]).split())}


def xml_events(text: str) -> Iterator[tuple]:
    """Events of a document, parsed piece by piece; names get the prefix that their namespace was declared with last."""
    parser = ElementTree.XMLPullParser(events=("start", "end", "start-ns"))
    prefixes = {XML_NAMESPACE: "xml"}

    def split(name: str) -> tuple[str, str, str]:
        namespace, _, local = name[1:].rpartition("}") if name[:1] == "{" else ("", "", name)
        prefix = prefixes.get(namespace, "")
        return f"{prefix}:{local}" if prefix else local, local, namespace

    parents: list = []

    def ready() -> Iterator[tuple]:
        for kind, x in parser.read_events():
            if kind == "start-ns":
                prefixes[x[1]] = x[0]
            elif kind == "start":
                yield ("start", *split(x.tag), {split(k)[0]: v for k, v in x.attrib.items()})
                parents.append(x)
            else:
                parents.pop()
                if x.text:
                    yield ("text", x.text)
                for child in x:
                    if child.tail:
                        yield ("text", child.tail)
                yield ("end",)
                del x[:]

    for k in range(0, len(text), 1 << 16):
        parser.feed(text[k : k + (1 << 16)])
        yield from ready()
    parser.close()
    yield from ready()


def _nodes(docs: DataFrame, key: str, text: str, events) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, document in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for node in numbered(events(document)) if document else ():
                    keys.append(k)
                    rows.append(node)
                    if len(rows) >= ROWS:
                        yield out(batch, keys, rows)
                        keys, rows = [], []
            if rows:
                yield out(batch, keys, rows)

    def out(batch: pa.RecordBatch, keys: list, rows: list[dict]) -> pa.RecordBatch:
        table = pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
        return pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *table.columns], names=[key, *table.schema.names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, {NODES}")


def xml_nodes(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """Nodes of the XML in a column; null and empty ones have none, one that isn't well-formed fails the job."""
    return _nodes(docs, key, xml, xml_events)


def html_nodes(docs: DataFrame, key: str, html: str) -> DataFrame:
    """Nodes of the HTML in a column: elements without content end where they begin, an end tag ends what is open inside of its
    element, and one without a begin counts for nothing. Names have no namespace."""
    return _nodes(docs, key, html, html_events)


def _side(nodes: DataFrame, key: str, letter: str, *columns: str) -> DataFrame:
    return nodes.select(key, *[F.col(c).alias(f"{letter}_{c}") for c in ("pre", "last", "parent", *columns)])


_PAIRED = {"parent": "child", "ancestor": "descendant", "preceding-sibling": "following-sibling", "preceding": "following"}


def related(left: DataFrame, right: DataFrame, axis: str, key: str, *columns: str) -> DataFrame:
    """Pairs of nodes of one document, the right one on an axis of the left one: key, a_pre, b_pre, and columns of both with these
    prefixes. Axes: child, parent, descendant, ancestor, following-sibling, preceding-sibling, following, preceding."""
    if axis in _PAIRED:
        pairs = related(right, left, _PAIRED[axis], key, *columns)
        other = {"a_": "b_", "b_": "a_"}
        return pairs.select(*[F.col(f"`{c}`").alias(other[c[:2]] + c[2:]) if c[:2] in other else F.col(f"`{c}`") for c in pairs.columns])
    a, b = _side(left, key, "a", *columns), _side(right, key, "b", *columns)
    if axis == "child":
        pairs = a.join(b, (a[key] == b[key]) & (F.col("a_pre") == F.col("b_parent"))).drop(b[key])
    elif axis == "descendant":
        pairs = pairs_within(a.withColumn("from", F.col("a_pre") + 1), b, [key], "from", "a_last", "b_pre")
    elif axis == "following-sibling":
        pairs = a.join(b, (a[key] == b[key]) & (F.col("a_parent") == F.col("b_parent")) & (F.col("a_pre") < F.col("b_pre"))).drop(b[key])
    elif axis == "following":
        pairs = pairs_within(_behind(a, b), b, [key], "from", "to", "b_pre")
    else:
        raise ValueError(f"no axis {axis}")
    return pairs.select(key, "a_pre", "b_pre", *[f"{x}_{c}" for x in "ab" for c in columns])


def _behind(a: DataFrame, b: DataFrame) -> DataFrame:
    """a with the range behind each node, to the end of the longest document."""
    end = b.agg(F.max("b_pre")).first()[0] or 0
    return a.withColumn("from", F.col("a_last") + 1).withColumn("to", F.lit(2 ** int(end).bit_length() - 1).cast("long"))


def related_counts(left: DataFrame, right: DataFrame, axis: str, key: str, by: str = "name") -> DataFrame:
    """Per left node how many right nodes of each `by` are on its axis descendant or following: key, a_pre, b_<by>, n. No pair is
    made, so it holds for any document."""
    a, b = _side(left, key, "a").drop("a_parent"), _side(right, key, "b", by)
    if axis == "descendant":
        ranged, low, high = a.withColumn("from", F.col("a_pre") + 1), "from", "a_last"
    elif axis == "following":
        ranged, low, high = _behind(a, b), "from", "to"
    else:
        raise ValueError(f"no counts of axis {axis}")
    return counts_within(ranged, b, [key], low, high, "b_pre", [f"b_{by}"]).select(key, "a_pre", f"b_{by}", "n")


def structure(nodes: DataFrame) -> DataFrame:
    """(kind, name, n): how often there are elements, attributes (element@name), pairs of parent and child, depths and namespaces."""
    own = F.array(
        F.struct(F.lit("element").alias("kind"), F.col("name")),
        F.struct(F.lit("depth").alias("kind"), F.col("depth").cast("string").alias("name")),
        F.struct(F.lit("namespace").alias("kind"), F.when(F.col("namespace") == "", "(sem namespace)").otherwise(F.col("namespace")).alias("name")),
        F.struct(F.lit("relation").alias("kind"), F.when(F.col("above") != "", F.concat("above", F.lit(" > "), "name")).alias("name")),
    )
    attributes = F.transform(F.map_keys("attributes"), lambda k: F.struct(F.lit("attribute").alias("kind"), F.concat("name", F.lit("@"), k).alias("name")))
    rows = nodes.select(F.explode(F.concat(own, attributes)).alias("x")).select("x.kind", "x.name").where("name IS NOT NULL")
    return rows.groupBy("kind", "name").agg(F.count("*").alias("n"))


def _parsed(text: str, start: Callable, end: Callable) -> None:
    """A document's elements by start (name, namespace, attributes) and end (), named as in xml_events()."""
    prefixes = {XML_NAMESPACE: "xml"}
    known: dict[str, tuple[str, str]] = {}

    def named(name: str) -> tuple[str, str]:
        if name not in known:
            namespace, _, local = name.rpartition("}")
            prefix = prefixes.get(namespace, "")
            known[name] = (f"{prefix}:{local}" if prefix else local, namespace)
        return known[name]

    def declared(prefix: str | None, namespace: str | None) -> None:
        prefixes[namespace or ""] = prefix or ""
        known.clear()

    parser = expat.ParserCreate(namespace_separator="}")
    parser.StartNamespaceDeclHandler = declared
    parser.StartElementHandler = lambda name, attributes: start(*named(name), [named(k)[0] for k in attributes])
    parser.EndElementHandler = lambda name: end()
    parser.Parse(text, True)


def _axes(text: str, counts: Counter) -> None:
    """Adds how many pairs of a document's nodes stand on each axis, by names; what is held grows with its depth and its names."""
    open_: list[tuple[str, Counter]] = []
    above: Counter = Counter()
    ended: Counter = Counter()

    def start(name: str, namespace: str, attributes: list[str]) -> None:
        if open_:
            parent, siblings = open_[-1]
            counts["child", parent, name] += 1
            for other, n in siblings.items():
                counts["following-sibling", other, name] += n
            siblings[name] += 1
        for other, n in above.items():
            if n:
                counts["descendant", other, name] += n
        for other, n in ended.items():
            counts["following", other, name] += n
        above[name] += 1
        open_.append((name, Counter()))

    def end() -> None:
        name, _ = open_.pop()
        above[name] -= 1
        ended[name] += 1

    _parsed(text, start, end)


def _structure(text: str, counts: Counter) -> None:
    open_ = [""]

    def start(name: str, namespace: str, attributes: list[str]) -> None:
        counts["element", name] += 1
        counts["depth", str(len(open_))] += 1
        counts["namespace", namespace or "(sem namespace)"] += 1
        if len(open_) > 1:
            counts["relation", f"{open_[-1]} > {name}"] += 1
        for attribute in attributes:
            counts["attribute", f"{name}@{attribute}"] += 1
        open_.append(name)

    _parsed(text, start, open_.pop)


def _tallied(docs: DataFrame, xml: str, tally: Callable[[str, Counter], None], names: list[str]) -> DataFrame:
    """names and n: what tally counts in the XML of a column. Tasks count while they read, so only counts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            columns = [pa.array(column, pa.string()) for column in zip(*counts, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], names=[*names, "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                for text in batch.column(0).slice(start, 1000).to_pylist():
                    if text:
                        tally(text, counts)
                    if len(counts) >= ROWS:
                        yield out()
                        counts.clear()
        if counts:
            yield out()

    rows = docs.select(F.col(xml).cast("string")).mapInArrow(run, ", ".join([*(f"{name} string" for name in names), "n long"]))
    return rows.groupBy(*names).agg(F.sum("n").alias("n"))


def axis_counts(docs: DataFrame, xml: str) -> DataFrame:
    """(axis, outer_name, inner_name, n): how many pairs of nodes of one document stand on each axis, by their names, in the XML of
    a column. No node and no pair is made a row; related() gives the pairs themselves."""
    found = _tallied(docs, xml, _axes, ["axis", "outer_name", "inner_name"])
    # seen from the other side, descendants are ancestors
    same = F.struct("axis", "outer_name", "inner_name", "n")
    other = F.struct(F.lit("ancestor").alias("axis"), F.col("inner_name").alias("outer_name"), F.col("outer_name").alias("inner_name"), "n")
    return found.select(F.explode(F.when(F.col("axis") == "descendant", F.array(same, other)).otherwise(F.array(same))).alias("x")).select("x.*")


def structure_counts(docs: DataFrame, xml: str) -> DataFrame:
    """structure() of the nodes of the XML in a column, without a row per node."""
    return _tallied(docs, xml, _structure, ["kind", "name"])
