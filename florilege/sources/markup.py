"""HTML: node tables, links and images, tables, embedded JSON, trees."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset("br p div li tr h1 h2 h3 h4 h5 h6".split())


class _Events(HTMLParser):
    """Elements as events; a closing tag closes what is open inside it, and at the end all that is open closes."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[str] = []
        self.seen: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        self.seen.append(("start", tag, tag, "", {k: v or "" for k, v in attrs}))
        if tag in VOID:
            self.seen.append(("end",))
        else:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            self.seen.append(("end",))
            while self.open.pop() != tag:
                self.seen.append(("end",))

    def handle_data(self, data):
        self.seen.append(("text", data))


def html_events(page: str, piece: int = 1 << 16) -> Iterator[tuple]:
    """("start", name, local, namespace, attributes), ("text", text) and ("end",) events of a page, parsed piece by piece."""
    parser = _Events()
    for k in range(0, len(page), piece):
        fed(parser, page[k : k + piece], k + piece >= len(page))
        yield from parser.seen
        parser.seen.clear()
    yield from [("end",)] * len(parser.open)


class _Content(HTMLParser):
    """Text, links, images and headings; image addresses prefer data-orig-file; short-code elements are counted."""

    def __init__(self) -> None:
        super().__init__()
        self.text: list[str] = []
        self.links: list[dict] = []
        self.images: list[dict] = []
        self.headings: list[str] = []
        self.shortcodes = 0
        self.skip = self.heading = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.shortcodes += "data-shortcode-data" in a
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "a" and a.get("href"):
            self.links.append({"href": a["href"], "title": a.get("title") or ""})
        elif tag == "img" and (a.get("data-orig-file") or a.get("src")):
            src = a.get("data-orig-file") or a["src"]
            if all(x["src"] != src for x in self.images):
                self.images.append({"src": src, "alt": a.get("alt") or ""})
        elif tag in ("h1", "h2", "h3"):
            self.heading += 1
            self.headings.append("")
        if tag in BREAKS:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("h1", "h2", "h3"):
            self.heading = max(0, self.heading - 1)
        if tag in BREAKS:
            self.text.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
            if self.heading and self.headings:
                self.headings[-1] += data


class _Table(HTMLParser):
    """Rows of cells of the tables with one of the ids."""

    def __init__(self, table_id: str) -> None:
        super().__init__()
        self.wanted, self.inside = table_id, 0
        self.rows: list[list[dict]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.inside += bool(self.inside or a.get("id") == self.wanted)
        if not self.inside:
            return
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append({"text": "", "links": [], "images": []})
        elif self.rows and self.rows[-1]:
            cell = self.rows[-1][-1]
            if tag == "a" and a.get("href"):
                cell["links"].append(a["href"])
            elif tag == "img" and a.get("src"):
                cell["images"].append(a["src"])
            elif tag in ("br", "p", "div"):
                cell["text"] += "\n"

    def handle_endtag(self, tag):
        if tag == "table":
            self.inside = max(0, self.inside - 1)

    def handle_data(self, data):
        if self.inside and self.rows and self.rows[-1]:
            self.rows[-1][-1]["text"] += data


def fed(parser: HTMLParser, page: str | None, whole: bool = True) -> HTMLParser:
    try:
        parser.feed(page or "")
        if whole:
            parser.close()
    except (AssertionError, ValueError):
        pass
    return parser


#: Rows that a task holds parsed at once; a batch of Spark's may have 10,000 pages.
ROWS = 100


def _few(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of ROWS rows at most, at least one of each frame."""
    for frame in frames:
        for start in range(0, max(1, len(frame)), ROWS):
            yield frame.iloc[start : start + ROWS]


def contents(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text, links, images, headings, word_count, html_length, shortcodes) per page."""
    schema = "k long, text string, links array<struct<href:string,title:string>>, images array<struct<src:string,alt:string>>, headings array<string>, word_count long, html_length long, shortcodes long"

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _few(frames):
            rows = []
            for k, page in zip(frame["k"], frame["h"], strict=True):
                p = fed(_Content(), page)
                lines = [" ".join(x.split()) for x in "".join(p.text).split("\n")]
                text = "\n".join(x for x in lines if x)
                rows.append((k, text, p.links, p.images, [" ".join(h.split()) for h in p.headings], len(text.split()), len(page or ""), p.shortcodes))
            yield pd.DataFrame(rows, columns=["k", "text", "links", "images", "headings", "word_count", "html_length", "shortcodes"])

    return pages.select(F.col(key).cast("long").alias("k"), F.col(html).alias("h")).mapInPandas(read, schema).withColumnRenamed("k", key)


class WrongTable(ValueError):
    """A table whose header or width isn't the agreed one, or whose cells are too long."""


def table_rows(pages: DataFrame, key: str, html: str, table_id: str, header: list[str], longest: int = 1500) -> DataFrame:
    """(key, row, cells) of the table with an id, below its header; fails on another header, width or an overlong cell."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _few(frames):
            out = []
            for k, page in zip(frame["k"], frame["h"], strict=True):
                rows = [[{**c, "text": "\n".join(y for x in c["text"].split("\n") if (y := " ".join(x.split())))} for c in r] for r in fed(_Table(table_id), page).rows]
                if not rows:
                    continue
                if [c["text"] for c in rows[0]] != header:
                    raise WrongTable(f"header {[c['text'] for c in rows[0]]}")
                for n, cells in enumerate(rows[1:], 1):
                    if len(cells) != len(header) or any(len(c["text"]) > longest for c in cells):
                        raise WrongTable(f"row {n}")
                    out.append((k, n, cells))
            yield pd.DataFrame(out, columns=["k", "row", "cells"])

    return pages.select(F.col(key).cast("long").alias("k"), F.col(html).alias("h")).mapInPandas(read, "k long, row long, cells array<struct<text:string,links:array<string>,images:array<string>>>").withColumnRenamed("k", key)


def filled_rows(rows: DataFrame) -> DataFrame:
    """Rows in which a cell has text, a link or an image."""
    return rows.where(F.exists("cells", lambda c: (c["text"] != "") | (F.size(c["links"]) > 0) | (F.size(c["images"]) > 0)))


def after_marker(marker: str):
    """A function of text: the JSON value that begins after a marker, as JSON text; null if there is none. Script is never run."""

    @F.pandas_udf(StringType())
    def found(pages: pd.Series) -> pd.Series:
        def one(page: str) -> str | None:
            at = page.find(marker)
            try:
                return None if at < 0 else json.dumps(json.JSONDecoder().raw_decode(page[at + len(marker) :].lstrip())[0], ensure_ascii=False)
            except ValueError:
                return None

        return pages.map(one, na_action="ignore")

    return found


def flattened(trees: DataFrame, key: str, tree: str) -> DataFrame:
    """(key, place, node, parent, depth, metadata) of JSON trees {id, metadata, children}, depth first."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _few(frames):
            rows = []
            for k, text in zip(frame["k"], frame["t"], strict=True):
                todo, place = [(json.loads(text), None, 1)] if text else [], 0
                while todo:
                    node, parent, depth = todo.pop()
                    place += 1
                    rows.append((k, place, str(node.get("id")), parent, depth, {str(a): str(b) for a, b in (node.get("metadata") or {}).items()}))
                    todo += [(c, str(node.get("id")), depth + 1) for c in reversed(node.get("children") or [])]
            yield pd.DataFrame(rows, columns=["k", "place", "node", "parent", "depth", "metadata"])

    return trees.select(F.col(key).cast("long").alias("k"), F.col(tree).alias("t")).mapInPandas(read, "k long, place long, node string, parent string, depth long, metadata map<string,string>").withColumnRenamed("k", key)
