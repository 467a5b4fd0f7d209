"""Personal data by patterns, checksums and context, in DataFrame functions only.

A pattern proposes spans; validators (Luhn for cards, mod 97 for IBANs, ranges and digit counts for the rest) confirm
them; words before or after a span raise its score. Every confirmed span counts, whatever its score.

Defined results: a null text is empty and has no spans; a null doc_id and repeated rows are carried as they are; long texts are
read whole, and spans are found and cut by bytes, so that time follows a text's length; spans of several kinds that begin at the
same place are listed by kind; an empty table gives an empty result; only doc_id and text are read, so other columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import fresh

#: Characters before and after a span in which context words count.
CONTEXT_CHARS = 48
CONTEXT_GAIN = 0.2
#: Matches that are placed in one go; blocks keep the placing of a text with very many from growing with their square.
BLOCK = 64


@dataclass(frozen=True)
class Kind:
    """A kind of span. Patterns begin only where a run begins or the last match ended, so none retries inside a run."""

    name: str
    pattern: str
    score: float
    context: str
    base: bool = True


#: Patterns of the kinds, in the order of reports.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.7, "mail|contact|write|courriel|correo"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", 0.5, r"\bip\b|addr|host|server|login"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", 0.6, "card|visa|master|amex|credit|carte|karte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.5, r"phone|tel|call|mobile|\bfax\b"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", 0.6, "iban|account|bank|konto|compte|cuenta", False),
)

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(compact: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97."""
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _holds(kind: str, text: Column) -> Callable[[Column], Column]:
    """Whether a proposed span is confirmed."""
    return lambda s: _confirmed(kind, text, s)


def _confirmed(kind: str, text: Column, s: Column) -> Column:
    value = s["value"]
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        alone = ~F.concat_ws("", F.when(s["start"] > 0, F.substring(text, s["start"].cast("int"), F.lit(1))), F.substring(text, (s["end"] + 1).cast("int"), F.lit(1))).rlike("[A-Za-z0-9]")
        compact = F.regexp_replace(value, " ", "")
        return alone & F.length(compact).between(15, 34) & mod97(compact)
    return F.lit(True)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _running(xs: Column, part: Callable[[Column], Column], join: Callable[[Column, Column], Column], use: Callable[[Column, Column], Column]) -> Column:
    """use(x, all that comes before) for each x of an array: part(y) of what stands before x, joined, beginning with 0.

    An accumulator that holds an array would be copied at each step, so blocks of the array are joined first, then what stands
    before each block, then what stands before x in its block.
    """
    zero = F.lit(0).cast("long")
    add = lambda acc, y: join(acc, part(y))

    def each(block: Column, before: Column) -> Column:
        return F.transform(block, lambda x, i: _bound(F.aggregate(F.slice(block, F.lit(1), i), before, add), lambda sofar: use(x, sofar)))

    def over(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, zero, add))
        placed = lambda ts: F.transform(blocks, lambda block, k: _bound(F.aggregate(F.slice(ts, F.lit(1), k), zero, join), lambda before: each(block, before)))
        return F.flatten(_bound(totals, placed))

    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK)))
    return _bound(_bound(xs, cut), over)


_SPANS = "array<struct<start:bigint,end:bigint,from:bigint,to:bigint,value:string>>"


def _proposed(text: Column, pattern: str) -> Column:
    """Matches as (start, end, from, to, value): what lies between matches gives the places, in characters and in bytes."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # both lengths in one number, characters above bytes
    length = lambda x: F.shiftleft(F.length(x).cast("long"), 32) + F.octet_length(x)
    both = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(m.alias("value"), length(g).alias("gap"), (length(g) + length(m)).alias("whole")))

    def span(x: Column, before: Column) -> Column:
        begin, end = before + x["gap"], before + x["whole"]
        char, byte = (lambda v: F.shiftright(v, 32)), (lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
        return F.struct(char(begin).alias("start"), char(end).alias("end"), byte(begin).alias("from"), byte(end).alias("to"), x["value"].alias("value"))

    every = _running(both, lambda x: x["whole"], lambda a, b: a + b, span)
    return F.when(text.rlike(pattern), every).otherwise(F.array().cast(_SPANS))


def _with_spans(docs: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds a struct column `name` with an array of confirmed spans per kind."""
    return docs.withColumn(name, F.struct(*[F.filter(_proposed(text, k.pattern), _holds(k.name, text)).alias(k.name) for k in KINDS]))


def _listed(kind: Kind, spans: Column) -> Column:
    return F.transform(spans[kind.name], lambda s: F.concat_ws(":", F.lit(kind.name), s["start"].cast("string"), s["end"].cast("string")))


def _scored(kind: Kind, spans: Column, text: Column) -> Column:
    most = 4 * CONTEXT_CHARS  # bytes that hold so many characters

    def score(s: Column, binary: Column) -> Column:
        begin = F.greatest(s["from"] - most, F.lit(0))
        before = F.substring(binary, (begin + 1).cast("int"), (s["from"] - begin).cast("int")).cast("string")
        after = F.substring(binary, (s["to"] + 1).cast("int"), F.lit(most)).cast("string")
        near = F.lower(F.concat(F.right(before, F.lit(CONTEXT_CHARS)), F.lit("\n"), F.left(after, F.lit(CONTEXT_CHARS))))
        return F.round(F.lit(kind.score) + F.when(near.rlike(kind.context), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0)), 2)

    return _bound(text.cast("binary"), lambda binary: F.transform(spans[kind.name], lambda s: score(s, binary)))


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban, scores (in the order of spans)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = _with_spans(docs.select("doc_id", text.alias("text")), F.col("text"), "found")
    spans = F.col("found")
    base = F.concat(*[_listed(k, spans) for k in KINDS if k.base])
    every = F.concat(*[_listed(k, spans) for k in KINDS])
    count = lambda k: F.size(spans[k]).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id",
        *[count(k.name) for k in KINDS if k.base],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
        *[count(k.name) for k in KINDS if not k.base],
        F.concat(*[_scored(k, spans, F.col("text")) for k in KINDS]).alias("scores"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns, each confirmed span in text replaced by its kind in brackets; null texts stay null.

    Of spans that overlap, the first one's kind stands for all of them.
    """
    name = fresh("spans", docs.columns)
    text, cut = F.col("text"), fresh("cut", [*docs.columns, name])
    out = _with_spans(docs, F.coalesce(text.cast("string"), F.lit("")), name)
    marked = lambda k: F.transform(F.col(name)[k.name], lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"), F.lit(f"[{k.name.upper()}]").alias("mark")))
    out = out.withColumn(cut, F.array_sort(F.concat(*map(marked, KINDS))))

    def joined(binary: Column) -> Column:
        piece = lambda a, b: F.substring(binary, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
        shown = lambda s, upto: F.when(s["from"] >= upto, F.concat(piece(upto, s["from"]), s["mark"])).otherwise("")
        parts = _running(F.col(cut), lambda s: s["to"], lambda a, b: F.greatest(a, b), shown)
        return F.concat(F.array_join(parts, ""), piece(F.array_max(F.transform(cut, lambda s: s["to"])), F.octet_length(binary)))

    return out.withColumn("text", F.when(F.size(cut) > 0, _bound(text.cast("binary"), joined)).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _sql_near(kind: Kind) -> str:
    """The score of a span at a to b of text."""
    near = f"lower(substr(text, greatest(a - {CONTEXT_CHARS}, 0) + 1, least(a, {CONTEXT_CHARS})) || chr(10) || substr(text, b + 1, {CONTEXT_CHARS}))"
    return f"CAST(CAST({kind.score} + CASE WHEN regexp_matches({near}, '{kind.context}') THEN {CONTEXT_GAIN} ELSE 0 END AS DECIMAL(3, 2)) AS VARCHAR)"


def _sql_kind(kind: str, pattern: str, keep: str) -> str:
    """Spans of a kind in DuckDB SQL; `keep` sees value v, start a and end b."""
    return f"""{kind}_m AS (SELECT row_nr, text, regexp_extract_all(text, '{pattern}') AS m, list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) AS g FROM d),
{kind}_u AS (SELECT row_nr, text, unnest(range(1, len(m) + 1)) AS i, m, g FROM {kind}_m),
{kind}_p AS (SELECT row_nr, text, m[i] AS v, CAST(list_sum(g[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM {kind}_u),
{kind}_s AS (SELECT row_nr, count(*) AS n, string_agg('{kind}:' || a || ':' || b, ',' ORDER BY a) AS s, string_agg({_sql_near(next(k for k in KINDS if k.name == kind))}, ',' ORDER BY a) AS c FROM (SELECT *, a + length(v) AS b FROM {kind}_p) WHERE {keep} GROUP BY row_nr)"""


_SQL_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_SQL_LUHN = f"list_sum(list_transform(range(1, length({_SQL_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_SQL_DIGITS}), i, 1) AS INT) WHEN CAST(substr(reverse({_SQL_DIGITS}), i, 1) AS INT) > 4 THEN CAST(substr(reverse({_SQL_DIGITS}), i, 1) AS INT) * 2 - 9 ELSE CAST(substr(reverse({_SQL_DIGITS}), i, 1) AS INT) * 2 END)) % 10 = 0"
_SQL_IBAN = "replace(v, ' ', '')"
_SQL_TURNED = f"(substr({_SQL_IBAN}, 5) || substr({_SQL_IBAN}, 1, 4))"
_SQL_MOD97 = f"list_reduce(list_concat([0], list_transform(range(1, length({_SQL_TURNED}) + 1), lambda i: ascii(substr({_SQL_TURNED}, i, 1)))), lambda r, c: CASE WHEN c >= 65 THEN (r * 100 + c - 55) % 97 ELSE (r * 10 + c - 48) % 97 END) = 1"

ORACLE_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS row_nr, doc_id, coalesce(text, '') AS text FROM documents),\n"
    + ",\n".join(
        (
            _sql_kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
            _sql_kind("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0"),
            _sql_kind("card", r"[0-9](?:[ -]?[0-9])+", f"length({_SQL_DIGITS}) BETWEEN 13 AND 19 AND {_SQL_LUHN}"),
            _sql_kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_SQL_DIGITS}) BETWEEN 9 AND 15"),
            _sql_kind("iban", KINDS[4].pattern, f"NOT regexp_matches(CASE WHEN a > 0 THEN substr(text, a, 1) ELSE '' END || substr(text, b + 1, 1), '[A-Za-z0-9]') AND length({_SQL_IBAN}) BETWEEN 15 AND 34 AND {_SQL_MOD97}"),
        )
    )
    + """
SELECT d.doc_id, coalesce(email_s.n, 0) AS n_email, coalesce(ip_s.n, 0) AS n_ip, coalesce(card_s.n, 0) AS n_card, coalesce(phone_s.n, 0) AS n_phone,
  sha256(concat_ws(',', email_s.s, ip_s.s, card_s.s, phone_s.s)) AS base_sha256, concat_ws(',', email_s.s, ip_s.s, card_s.s, phone_s.s, iban_s.s) AS spans, coalesce(iban_s.n, 0) AS n_iban,
  concat_ws(',', email_s.c, ip_s.c, card_s.c, phone_s.c, iban_s.c) AS scores
FROM d LEFT JOIN email_s USING (row_nr) LEFT JOIN ip_s USING (row_nr) LEFT JOIN card_s USING (row_nr) LEFT JOIN phone_s USING (row_nr) LEFT JOIN iban_s USING (row_nr)"""
)
