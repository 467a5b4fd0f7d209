"""Grammars of documents, checked by derivatives while a document is read.

A grammar has a line for each kind of element:

    entry = @xml:id{DLP-.+} @volp?{only|yes|no} form+ gramGrp? (sense | xr)* meta
    sense = @n?{[0-9]+} def+ sense:inner*
    inner as sense = def
    def = text

First come attributes: @name must be there, @name? may be; {pattern} is what values must match as a whole. Then children, as a
regular expression of names with | ( ) * + ?; name:kind is a child of that name whose own content another line describes, which
says "kind as name" or just "kind". text allows characters, any allows whatever children there are, unchecked.

The children that may still come are an expression too: its derivative by the child that came. So a document is checked in one
pass, holding an expression for each open element. After a mistake the check goes on: where one missing element explains what
came, it is taken as missing, else what came is passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.operators.trees import xml_events

# -- expressions: ("none",) matches nothing, ("end",) nothing more, ("child", name), ("seq", a, b), ("or", a, b), ("many", a)

NONE, END = ("none",), ("end",)


def seq(a: tuple, b: tuple) -> tuple:
    if NONE in (a, b):
        return NONE
    return b if a == END else a if b == END else ("seq", a, b)


def either(a: tuple, b: tuple) -> tuple:
    """Choices are kept sorted and each once, so that few different expressions come up."""
    parts = set()
    for x in (a, b):
        while x[0] == "or":
            parts.add(x[1])
            x = x[2]
        if x != NONE:
            parts.add(x)
    out = NONE
    for x in sorted(parts, key=repr, reverse=True):
        out = x if out == NONE else ("or", x, out)
    return out


def many(a: tuple) -> tuple:
    return END if a in (NONE, END) else a if a[0] == "many" else ("many", a)


@cache
def may_end(e: tuple) -> bool:
    kind = e[0]
    return kind in ("end", "many") or (kind == "seq" and may_end(e[1]) and may_end(e[2])) or (kind == "or" and (may_end(e[1]) or may_end(e[2])))


@cache
def after(e: tuple, name: str) -> tuple:
    """The derivative: what may come after a child of that name."""
    kind = e[0]
    if kind == "child":
        return END if e[1] == name else NONE
    if kind == "seq":
        first = seq(after(e[1], name), e[2])
        return either(first, after(e[2], name)) if may_end(e[1]) else first
    if kind == "or":
        return either(after(e[1], name), after(e[2], name))
    return seq(after(e[1], name), e) if kind == "many" else NONE


@cache
def next_names(e: tuple) -> tuple[str, ...]:
    """Names of the children that may come now, sorted."""
    kind = e[0]
    if kind == "child":
        return (e[1],)
    if kind in ("none", "end"):
        return ()
    if kind == "many":
        return next_names(e[1])
    found = set(next_names(e[1]))
    if kind == "or" or may_end(e[1]):
        found |= set(next_names(e[2]))
    return tuple(sorted(found))


# -- grammars


@dataclass(frozen=True)
class Kind:
    """What an element of a kind may have: attributes (name, required, pattern), children, and the kinds of these by name."""

    name: str
    attributes: tuple[tuple[str, bool, str | None], ...]
    children: tuple
    kinds: dict[str, str] = field(hash=False, default_factory=dict)
    text: bool = False
    any: bool = False


_ATTRIBUTE = re.compile(r"@([\w.:-]+)(\?)?(?:\{((?:[^{}]|\{[^{}]*\})*)\})?")
_TOKEN = re.compile(r"\s*(?:([\w.:-]+)|([|()*+?]))")
_LINE = re.compile(r"([\w.-]+(?::[\w.-]+)?)(?:\s+as\s+([\w.:-]+))?\s*=\s*(.*)")


class WrongGrammar(ValueError):
    """A grammar that can't be read."""


class Grammar:
    """The kinds of a grammar by name; prefixes are parts of names where a name has one."""

    def __init__(self, text: str, prefixes: tuple[str, ...] = ("xml",)):
        self.kinds: dict[str, Kind] = {}
        self.prefixes = frozenset(prefixes)
        for line in filter(None, (x.split("#")[0].strip() for x in text.splitlines())):
            found = _LINE.fullmatch(line)
            if not found or found[1] in self.kinds:
                raise WrongGrammar(line)
            self.kinds[found[1]] = self._kind(found[2] or found[1], found[3])
        for kind in self.kinds.values():
            for other in kind.kinds.values():
                if other not in self.kinds:
                    raise WrongGrammar(f"{other} isn't described")

    def _kind(self, name: str, body: str) -> Kind:
        attributes = []
        while found := _ATTRIBUTE.match(body):
            attributes.append((found[1], not found[2], found[3]))
            body = body[found.end() :].lstrip()
        tokens, at = [], 0
        while body[at:].strip():
            found = _TOKEN.match(body, at)
            if not found:
                raise WrongGrammar(body)
            tokens.append(found[1] or found[2])
            at = found.end()
        kinds: dict[str, str] = {}
        flags: set[str] = set()
        rest = tokens

        def choice() -> tuple:
            out = row()
            while rest and rest[0] == "|":
                rest.pop(0)
                out = either(out, row())
            return out

        def row() -> tuple:
            out = END
            while rest and rest[0] not in ("|", ")"):
                out = seq(out, one())
            return out

        def one() -> tuple:
            token = rest.pop(0)
            if token == "(":
                out = choice()
                if not rest or rest.pop(0) != ")":
                    raise WrongGrammar(f"{name}: ) is missing")
            elif token in ("text", "any"):
                flags.add(token)
                out = END
            elif token in "*+?":
                raise WrongGrammar(f"{name}: {token} follows nothing")
            else:
                child, _, kind = token.partition(":")
                if child in self.prefixes:
                    child, _, kind = f"{child}:{kind.partition(':')[0]}", "", kind.partition(":")[2]
                if kinds.setdefault(child, kind or child) != (kind or child):
                    raise WrongGrammar(f"{name}: {child} is of two kinds")
                out = ("child", child)
            while rest and rest[0] in ("*", "+", "?"):
                sign = rest.pop(0)
                out = many(out) if sign == "*" else seq(out, many(out)) if sign == "+" else either(END, out)
            return out

        children = choice()
        if rest:
            raise WrongGrammar(f"{name}: {rest[0]}")
        return Kind(name, tuple(attributes), children, kinds, "text" in flags, "any" in flags)


def mistakes(events: Iterator[tuple], grammar: Grammar, start: str) -> Iterator[str]:
    """What is wrong with a document, given as events, whose root is of the kind `start`."""
    open_: list[list] = []  # kind (None: unchecked), name, what may come
    for event in events:
        if event[0] == "start":
            _, name, _, _, attributes = event
            kind: Kind | None = None
            if not open_:
                kind = grammar.kinds[start]
                if name != kind.name:
                    yield f"Expecting an element {kind.name}, got {name}"
            elif (above := open_[-1][0]) and not above.any:
                expected = open_[-1][2]
                then = after(expected, name)
                if then == NONE:
                    missing = next((x for x in next_names(expected) if after(after(expected, x), name) != NONE), None)
                    if missing:
                        yield f"Expecting an element {missing}, got {name}"
                        then = after(after(expected, missing), name)
                    else:
                        yield f"Did not expect element {name} there"
                        then = expected
                open_[-1][2] = then
                kind = grammar.kinds.get(above.kinds.get(name, name))
            if kind:
                known = {a for a, _, _ in kind.attributes}
                for a in sorted(attributes.keys() - known):
                    yield f"Invalid attribute {a} for element {name}"
                for a, required, pattern in kind.attributes:
                    if a not in attributes:
                        if required:
                            yield f"Element {name} is missing attribute {a}"
                    elif pattern is not None and not re.fullmatch(pattern, attributes[a]):
                        yield f"Element {name} has a wrong value of attribute {a}"
            open_.append([kind, name, kind.children if kind else NONE, False])
        elif event[0] == "text":
            if open_ and (kind := open_[-1][0]) and not (kind.text or kind.any or open_[-1][3]) and event[1].strip():
                open_[-1][3] = True  # once for an element
                yield f"Did not expect text in element {open_[-1][1]} content"
        else:
            kind, name, expected, _ = open_.pop()
            if kind and not kind.any and not may_end(expected):
                names = next_names(expected)
                last = next((x for x in names if may_end(after(expected, x))), names[0])  # one that would end it, if any
                yield f"Expecting an element {last}, got nothing"


def validated(docs: DataFrame, key: str, xml: str, grammar: str, start: str, prefixes: tuple[str, ...] = ("xml",)) -> DataFrame:
    """(key, root, valid, errors) of each document: the attributes of its root, whether it has no mistakes, and these in order.

    What isn't well-formed is a mistake; null and empty documents lack their root. A document is checked where it is read; nothing
    is shuffled.
    """
    Grammar(grammar, prefixes)  # a grammar that can't be read fails here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Grammar(grammar, prefixes)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                root: list[tuple[str, str]] = []
                errors: list[str] = []
                try:
                    errors += mistakes(_noted(xml_events(text or ""), root), rules, start)
                except ElementTree.ParseError as e:
                    errors.append(f"ParseError: {e}")
                rows.append({"root": root, "valid": not errors, "errors": errors})
            made = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("root", pa.map_(pa.string(), pa.string())), ("valid", pa.bool_()), ("errors", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=[key, *made.schema.names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(xml).cast("string")).mapInArrow(run, f"`{key}` {kind}, root map<string,string>, valid boolean, errors array<string>")


def _noted(events: Iterator[tuple], root: list) -> Iterator[tuple]:
    """Events as they come; the root's attributes are added to root."""
    first = True
    for event in events:
        if first and event[0] == "start":
            root += event[4].items()
            first = False
        yield event
