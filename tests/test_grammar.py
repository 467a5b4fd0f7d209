"""Grammars: derivatives against regular expressions, mistakes in documents, grammars that can't be read."""

import random
import re
from itertools import product

import pytest

from florilege.operators.trees import xml_events
from florilege.rules import grammar

DICTIONARY = """
entry = @id{e[0-9]{1,2}} @kind?{a|b} form+ gram? (sense | m:see)* meta   # the root
form = text
gram = text
sense = @n? def+ sense:inner*
inner as sense = def
def = text any
m:see = text
meta =
"""


def found(text, rules=DICTIONARY, start="entry", prefixes=("xml", "m")):
    return list(grammar.mistakes(xml_events(text), grammar.Grammar(rules, prefixes), start))


def test_derivatives_against_regular_expressions():
    rng = random.Random(2)

    def expression(depth):
        if depth == 0 or rng.random() < 0.2:
            c = rng.choice("abc")
            return c, c
        kind = rng.randrange(4)
        a, x = expression(depth - 1)
        if kind == 0:
            sign = rng.choice("*+?")
            return f"({a}){sign}", f"(?:{x}){sign}"
        b, y = expression(depth - 1)
        return (f"({a} | {b})", f"(?:{x}|{y})") if kind == 1 else (f"{a} {b}", f"{x}{y}")

    words = ["".join(w) for n in range(5) for w in product("abc", repeat=n)]
    for _ in range(150):
        model, pattern = expression(3)
        start = grammar.Grammar(f"r = {model}\na =\nb =\nc =").kinds["r"].children
        for word in words:
            e = start
            for c in word:
                e = grammar.after(e, c)
            assert grammar.may_end(e) == bool(re.fullmatch(pattern, word)), (model, word)
            following = {c for c in "abc" if grammar.after(e, c) != grammar.NONE}
            assert set(grammar.next_names(e)) == following


def test_misplaced_repeated_and_missing_elements():
    ns = 'xmlns:m="urn:m"'
    assert found(f'<entry {ns} id="e1"><form>x</form><form/><gram/><sense n="1"><def>a<b/>c</def><sense><def/></sense></sense><m:see>y</m:see><sense><def/></sense><meta/></entry>') == []
    assert found('<entry id="e1"><form/><meta/><gram/></entry>') == ["Did not expect element gram there"]
    assert found('<entry id="e1"><form/><gram/><gram/><meta/></entry>') == ["Did not expect element gram there"]
    assert found('<entry id="e1"><gram/><meta/></entry>') == ["Expecting an element form, got gram"]
    assert found('<entry id="e1"><form/><sense><def/></sense></entry>') == ["Expecting an element meta, got nothing"]
    assert found('<entry id="e1"><form/><sense><def/><sense><def/><sense/></sense></sense><meta/></entry>') == ["Did not expect element sense there", "Expecting an element def, got nothing"]
    assert found('<entry id="x" kind="c" other="1"><form><i/></form><meta>t<!-- c --> t</meta></entry>') == [
        "Invalid attribute other for element entry",
        "Element entry has a wrong value of attribute id",
        "Element entry has a wrong value of attribute kind",
        "Did not expect element i there",
        "Did not expect text in element meta content",
    ]
    assert found("<entry><form/><unknown><x/>text</unknown><meta/></entry>") == ["Element entry is missing attribute id", "Did not expect element unknown there"]
    assert found('<other id="e1"><form/><meta/></other>') == ["Expecting an element entry, got other"]


def test_grammars_that_cannot_be_read():
    for text in ("entry form", "a = b", "a = (b\nb =", "a = b)\nb =", "a = *", "a = b$\nb =", "a =\na =", "a = b:x b:y\nx =\ny =", "a = b:c\nb ="):
        with pytest.raises(grammar.WrongGrammar):
            grammar.Grammar(text)


def test_documents_in_a_table(spark):
    rows = [(1, '<entry id="e1"><form>x</form><meta/></entry>'), (2, '<entry id="e2"><form/>'), (3, None), (4, ""), (5, '<entry id="e5" kind="a"><meta/></entry>')]
    df = spark.createDataFrame(rows, "valid long, errors string")
    got = {r["valid"]: r for r in grammar.validated(df.withColumnRenamed("valid", "k"), "k", "errors", DICTIONARY, "entry", ("xml", "m")).toDF("valid", "root", "ok", "errors").collect()}
    assert [got[k]["ok"] for k in range(1, 6)] == [True, False, False, False, False]
    assert got[5]["root"] == {"id": "e5", "kind": "a"} and got[5]["errors"] == ["Expecting an element form, got meta"]
    assert all(got[k]["errors"][-1].startswith("ParseError") for k in (2, 3, 4))
    with pytest.raises(grammar.WrongGrammar):
        grammar.validated(df, "valid", "errors", "a = b", "a")
    assert grammar.validated(df.limit(0), "valid", "errors", DICTIONARY, "entry", ("xml", "m")).count() == 0
