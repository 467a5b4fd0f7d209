import datetime

import pytest
from pyspark.sql import functions as F

from florilege.functions import dates, hashing, text, urls


def values(spark, cells, make, name="x"):
    df = spark.createDataFrame([(c,) for c in cells], f"{name} string")
    return [r[0] for r in df.select(make(F.col(name)).alias("y")).collect()]


def test_strip_html_decodes_after_tags(spark):
    cells = ["<p>A&nbsp; b</p><script>var t='</p>';</script> &lt;b&gt; &amp;lt;", None, "<style>p{}</style>x"]
    assert values(spark, cells, text.strip_html) == ["A b <b> &lt;", "", "x"]
    assert values(spark, ["&eacute;t&#233; [gallery ids=1]"], lambda c: text.strip_html(c, exact=True, shortcodes=True)) == ["été"]


def test_norm_text_and_tokens(spark):
    assert values(spark, ["Ação  de É-tudes 2024", "ﬁm"], text.norm_text) == ["acao de e tudes 2024", "m"]
    assert values(spark, ["ﬁm Ação"], lambda c: text.norm_text(c, exact=True)) == ["fim acao"]
    assert values(spark, ["A casa da praia 2024 no mar"], text.token_list) == [["casa", "praia"]]
    assert values(spark, ["casa-da-praia%20azul"], text.slug_tokens) == [["casa", "praia", "azul"]]


@pytest.mark.parametrize(
    ("cell", "expected"),
    [
        ("Ã\x89t", ["encoding"]), ("a  b", ["double space"]), ("casa casa", ["repeated word"]), ("oh!!", ["repeated punctuation"]), ("(a", ["unbalanced brackets"]),
        ("a_ b", ["odd underscore"]), ("&lt;b", ["visible markup"]), ("coool", ["tripled letter"]), ("bem", []), ("", []),
    ],
)
def test_quality_warnings(spark, cell, expected):
    found = values(spark, [cell], text.quality_warnings)[0]
    assert found == expected


def test_words(spark):
    assert values(spark, ["the the casa casa an an x x"], text.repeated_words) == [["casa"]]
    assert values(spark, ["cooool"], text.collapsed) == [["col", "cool"]]
    assert values(spark, ["occurr", "abc"], text.collapsed) == [["ocurr", "occurr", "occur"], []]
    assert values(spark, ["Casa casa. fim Fim, o fim", "x x"], text.repeated_in) == [["Casa", "fim"], []]
    assert values(spark, ["a b c d", "a b"], lambda c: text.trimmed_words(c, 3)) == ["a b c…", "a b"]
    assert values(spark, ["XIV", "abc", ""], text.is_roman) == [True, False, False]
    assert values(spark, ["Um. Dois! \n\n Três"], text.paragraphs) == [["Um.", "Dois!", "Três"]]
    assert values(spark, ["x" * 200], lambda c: F.length(text.shortened(c))) == [140]
    assert values(spark, ["Element '" + "y" * 70 + "' at DLP-a_1-2, bad"], text.masked_error) == ["Element '…' at DLP-…, bad"]
    assert values(spark, ["São João & Co."], text.slugify) == ["sao-joao-co"]


SITE = "https://www.site.org"


@pytest.mark.parametrize(
    ("target", "expected"),
    [
        ("https://site.org/a", True), ("https://www.site.org/a", True), ("https://sub.site.org/", True), ("https://other.net/", False), ("HTTPS://SITE.ORG:443/x", True), ("https://site.org.evil.net/", False),
        ("https://mysite.org/", False), ("https://site.org@evil.net/", False), ("mailto:a@site.org", False), ("/relative", False), ("https://site.org./", True), ("https://sité.org/", False),
    ],
)
def test_internal(spark, target, expected):
    assert values(spark, [target], lambda c: urls.is_internal(c, F.lit(SITE))) == [expected]


def test_international_hosts(spark):
    site = F.lit("https://xn--mnchen-3ya.de")
    assert values(spark, ["https://münchen.de/a", "HTTPS://www.MÜNCHEN.de:8080", "https://münchen.de.org"], lambda c: urls.is_internal(c, site)) == [True, True, False]


def test_canonical_queries(spark):
    cells = ["http://h.org/a;p=1?b=x y&a=%7E", "http://h.org/a;x/b;y?flag&UTM_q=1&k=%zz&s=*"]
    assert values(spark, cells, urls.canonical) == ["http://h.org/a?b=x+y&a=~", "http://h.org/a;x/b?flag=&k=%25zz&s=%2A"]


def test_urls(spark):
    cells = ["HTTPS://Site.org//a//b?utm_source=x&q=1#top", "//site.org/x", "relative/x", "https://site.org"]
    assert values(spark, cells, urls.canonical) == ["https://site.org/a/b?q=1", "https://site.org/x", "relative/x", "https://site.org/"]
    base = "https://site.org/a/b.html?x=1"
    refs = ["/c", "d", "//e.org/f", "https://g.org", "#h", "?y=2", ""]
    got = values(spark, refs, lambda c: urls.resolved(F.lit(base), c))
    assert got == ["https://site.org/c", "https://site.org/a/d", "https://e.org/f", "https://g.org", base + "#h", "https://site.org/a/b.html?y=2", base]
    assert values(spark, ["../x/./y"], lambda c: urls.joined(F.lit(base), c)) == ["https://site.org/x/y"]
    assert values(spark, ["https://Img.org/a.JPG?w=1", "https://no.org/a.jpg", "/a.jpg"], lambda c: urls.is_image(c, ("img.org",))) == [True, False, False]
    assert values(spark, ["https://s.org/a b?q=é"], urls.safe) == ["https://s.org/a%20b?q=%C3%A9"]


def test_partial_dates(spark):
    cells = ["1926", "1926/08", "1926/08/01", "1926?", "Z", "1930-1935", "1930/02/31", "", None]
    got = values(spark, cells, dates.partial_date)
    assert [None if g is None else g["precision"] for g in got] == [9, 10, 11, None, None, None, None, None, None]
    assert (got[1]["year"], got[1]["month"], got[1]["day"]) == (1926, 8, 0)


def test_parsed_dates(spark):
    cells = ["2017-4-3", "3/4/2017", "03-04-2017", "2017/04/03", "90/02/2016", "4/17/2017"]
    assert values(spark, cells, dates.parsed_date) == [datetime.date(2017, 4, 3)] * 4 + [None, None]


def test_digests(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, None, ""), ({"b": "2", "a": "1"}, "", None)], "m map<string,string>, x string, y string")
    rows = df.select(hashing.map_digest(F.col("m")).alias("m"), hashing.digest(F.col("x"), F.col("y")).alias("d")).collect()
    assert rows[0]["m"] == rows[1]["m"] and rows[0]["d"] != rows[1]["d"]
    sig = hashing.claim_signature(F.lit("P1"), F.lit("quantity"), F.lit("+4 [3, 5]"), F.array(F.lit("b"), F.lit("a")))
    assert df.select(sig).first()[0] == "P1|quantity|+4|a;b"
