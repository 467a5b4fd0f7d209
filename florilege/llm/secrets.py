"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty for what they miss.

A candidate is a long string in a sensitive context (a key word shortly before it, as a word or as a part of an identifier, or a
known prefix), or the secret part of a known form: a signed token, the password of an address, a hook's path, the lines of a key
block. NAME=value is a name and a value. Strings that are mostly made of words (identifiers, paths, long words) are none. A
candidate's marginal size is what it adds to the compressed surrounding text, where the compressor is primed with a dictionary of identifiers;
strings that hardly compress are reported, strings that repeat what stands around them or in the dictionary are not.

Defined results: a null text is empty and has no spans; a null doc_id and repeated rows are carried; long texts are read whole,
in time that follows their length; spans that begin at the same place are listed in the order of kinds; an empty table gives an
empty result; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import chunks

#: The base patterns, in the order of reports, and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Proposals of the novelty scan, the words that make a context sensitive, and prefixes that are sensitive themselves.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST_CHARS = 16
#: Parts of a candidate between inner '='; those at its end are padding.
PART = re.compile(r"[^=]+(?:=+\Z)?")
SENSITIVE = frozenset(
    "pass password passwords passwd passphrase pwd secret secrets token tokens key keys apikey apikeys accesskey secretkey privatekey authtoken accesstoken "
    "auth authorization bearer credential credentials private signature login session cookie".split()
)
#: Parts of identifiers: runs of capitals, words with or without a capital, numbers.
IDENTIFIER_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Candidates of a known form; group 1 is the secret, of FORM_LEAST characters or more.
FORMS = (
    re.compile(r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?)"),
    re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@]*:([^\s:/@]+)@"),
    re.compile(r"/services/((?:[A-Z0-9]{8,}/){2}[A-Za-z0-9]{16,})"),
)
FORM_LEAST = 8
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----([^-]*)(?:-----END|\Z)")
KEY_LINE = re.compile(r"[A-Za-z0-9+/=]{16,}")
PREFIXES = ("ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "sk-", "AIza", "eyJ", "ya29", "npm_", "SG")
CONTEXT_CHARS = 48
WINDOW_CHARS = 512
#: Least marginal bytes per character of a candidate; hexadecimal digits hold four bits at most.
LEAST_NOVELTY, LEAST_HEX_NOVELTY = 0.62, 0.42
#: A string with this share of its characters in words is no secret.
WORDS_SHARE = 0.6

#: The dictionary that primes the compressor: identifiers and words common in code and prose.
IDENTIFIERS = (
    "abstract account admin address allow android application argument array assert async attribute authentication authorization available await "
    "background base64 begin binary boolean boundary branch browser buffer build button bytes cache callback certificate change channel character "
    "charset check class client cluster code collection column command commit common compile component config configuration connection console const "
    "constant constructor container content context control cookie count create credential current cursor customer data database date debug decode "
    "default define delete description deploy development device dictionary directory disable document domain double download driver dynamic element "
    "email enable encode encoding encryption endpoint engine entry enum environment error event example exception execute expire export extends false "
    "feature field file filter final finally float folder format from function generate getter global group handler hash header host html http https "
    "identifier image implements import include index info initialize input insert instance integer interface internal interval invalid item iterator "
    "javascript json kernel keyboard label language length level library license limit line link list listener local location logger login loop main "
    "manager mapping master match maximum member memory message metadata method minimum model module monitor name namespace network node null number "
    "object offset operation option order output override package page parameter parent parse password path pattern permission pipeline platform "
    "plugin pointer policy port position prefix print private process production profile project property protected protocol provider proxy public "
    "python query queue random range read record redirect reference register release remote repository request required reset resource response "
    "result return role root route runtime schema scope script search secret section secure select sequence server service session setting signature "
    "size socket source stack standard start state static status storage stream string struct style submit subscription super support switch symbol "
    "system table target task template temporary test text thread timeout timestamp title token trace transaction transfer true type undefined unique "
    "update upload url user username utility valid value variable vector version view virtual void volume warning web window worker write xml yaml "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 xxxxxxxx XXXXXXXX 12345678 "
)

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


class Novelty:
    """Marginal compressed bytes of a string within its surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        raw = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)

    def marginal(self, before: str, candidate: str, after: str) -> int:
        size = lambda x: len(self.compressor.compress(x.encode("utf-8", "surrogatepass")))
        return size(before + after + candidate) - size(before + after)

    def holds(self, text: str, start: int, end: int) -> bool:
        candidate = text[start:end]
        before, after = text[max(0, start - WINDOW_CHARS) : start], text[end : end + WINDOW_CHARS]
        least = LEAST_HEX_NOVELTY if re.fullmatch("[0-9a-fA-F]+", candidate) else LEAST_NOVELTY
        return self.marginal(before, candidate, after) >= least * len(candidate)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end), in the order of reports."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _parts(m: re.Match) -> Iterator[tuple[int, int]]:
    """(start, end) of the long enough parts of a candidate; a name before '=' is one only with a digit."""
    for p in PART.finditer(m.group()):
        last = p.end() == m.end() - m.start()
        if p.end() - p.start() >= LEAST_CHARS and (last or any(c.isdigit() for c in p.group())):
            yield m.start() + p.start(), m.start() + p.end()


def sensitive(text: str, start: int) -> bool:
    """Whether a key word stands shortly before a place, as a word or as a part of an identifier."""
    left = max(0, start - CONTEXT_CHARS)
    for _ in range(CONTEXT_CHARS):  # a word that the window cuts is seen whole
        if left and text[left - 1].isalnum():
            left -= 1
    before = text[left:start]
    return any(p.lower() in SENSITIVE for p in IDENTIFIER_PART.findall(before)) or any(p.lower() in SENSITIVE for p in re.findall("[A-Za-z]+", before))


def of_words(value: str) -> bool:
    """Whether a string is mostly made of words: parts of three letters or more between signs, or of four or more that aren't all
    capitals, a fair share of them vowels."""
    held = 0
    for m in IDENTIFIER_PART.finditer(value):
        part = m.group()
        vowels = sum(c in "aeiouyAEIOUY" for c in part)
        apart = not value[max(0, m.start() - 1) : m.start()].isalnum() and not value[m.end() : m.end() + 1].isalnum()
        if part.isalpha() and len(part) >= (3 if apart else 4) and (apart or not part.isupper()) and 0.15 <= vowels / len(part) <= 0.75:
            held += len(part)
    return held >= WORDS_SHARE * len(value)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what may be a secret, in the order of kinds of candidates; those of known forms first."""
    for form in FORMS:
        if form is FORMS[0] and "eyJ" not in text or form is FORMS[1] and "://" not in text or form is FORMS[2] and "/services/" not in text:
            continue
        for m in form.finditer(text):
            if m.end(1) - m.start(1) >= FORM_LEAST:
                yield m.span(1)
    if "PRIVATE KEY-----" in text:
        for block in KEY_BLOCK.finditer(text):
            for m in KEY_LINE.finditer(text, *block.span(1)):
                yield m.span()
    for m in CANDIDATE.finditer(text):
        for start, end in _parts(m):
            value = text[start:end]
            if any(map(str.isalpha, value)) and (value.startswith(PREFIXES) or sensitive(text, start)):
                yield start, end


def novel_spans(text: str, known: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Candidates that overlap no base span and no earlier one, aren't made of words and hardly compress."""
    found: list[tuple[int, int, int]] = []
    starts, ends = sorted(a for a, _, _ in known), sorted(b for _, _, b in known)
    for start, end in candidates(text):
        if bisect_left(starts, end) > bisect_right(ends, start):  # more spans begin before its end than end before its start
            continue
        if not of_words(text[start:end]) and novelty.holds(text, start, end):
            found.append((start, 3, end))
            insort(starts, start)
            insort(ends, end)
    return sorted(found)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in (part for whole in batches for part in chunks(whole, "text")):
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                novel = novel_spans(text, base, novelty)
                counts = [sum(k == n for _, k, _ in base) for n in range(3)]
                rows.append((*counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(sorted(base + novel)), len(novel)))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            arrays = [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, SCHEMA)


def _sql_kind(kind: str, pattern: str, value: str, keep: str) -> str:
    """Base spans of a kind in DuckDB SQL; `keep` sees value v. Lengths of what lies between matches, summed up, give the places."""
    return f"""{kind}_m AS (SELECT nr, regexp_extract_all(text, '{pattern}') AS m, {value} AS v, list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) AS g FROM d),
{kind}_u AS (SELECT nr, unnest(range(1, len(m) + 1)) AS i, m, v, g FROM {kind}_m),
{kind}_p AS (SELECT nr, m[i] AS x, v[i] AS v, CAST(list_sum(g[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM {kind}_u),
{kind}_s AS (SELECT nr, '{kind}' AS kind, a, a + length(x) AS b FROM {kind}_p WHERE {keep})"""


_SQL_WORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_SQL_ASSIGN = rf"""({_SQL_WORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: The base spans; what novelty adds has no SQL.
BASE_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS nr, doc_id, coalesce(text, '') AS text FROM documents),\n"
    + ",\n".join(
        (
            _sql_kind("assign", _SQL_ASSIGN, f"regexp_extract_all(text, '{_SQL_ASSIGN}', 2)", "length(v) >= 6"),
            _sql_kind("access", "AKIA[A-Z0-9]+", "[]", "length(x) >= 20"),
            _sql_kind("hex", "[0-9a-f]+", "[]", "length(x) >= 24"),
        )
    )
    + """,
s AS (SELECT *, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END AS place FROM (FROM assign_s UNION ALL FROM access_s UNION ALL FROM hex_s)),
l AS (SELECT nr, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS listed, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM s GROUP BY nr)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(listed, '')) AS base_sha256 FROM d LEFT JOIN l USING (nr)"""
)
