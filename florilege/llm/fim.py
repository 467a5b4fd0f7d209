"""Fill-in-middle: documents cut in three, with the middle moved behind its surroundings.

A unit is a run of A-Z and a-z, or any other character. One Aho-Corasick automaton goes over a text and reports where its class
changes from letters to others or back, and sentinels. Between two such events units are counted by subtraction, a run of
letters being one and each other character one, so the place of any unit is found by a search among the events.

Defined results: null and empty texts are plain with no units; a null doc_id is hashed as an empty number, so such rows are all
treated alike, as are repeated rows; a text that holds a sentinel stays plain, so what is made can always be undone; texts are
looked at whole, in blocks; an empty table gives an empty one; only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import chunks

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, so many are changed; of those so many put the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
SEED = 1
#: Characters that one look of the automaton goes over.
BLOCK = 1 << 18

_BEGIN, _END, _SENTINEL = range(3)
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _symbols() -> tuple[bytes, str, str]:
    """A symbol for each byte; the symbols of letters and those of others. What sentinels are made of stays as it is."""
    letters = [c for c in range(128) if chr(c).isalpha()]
    own = sorted(set(PREFIX + SUFFIX + MIDDLE))
    table = bytearray(b"." * 256)
    for c in letters:
        table[c] = ord("a")
    for c in own:
        table[ord(c)] = ord(c)
    return bytes(table), "a" + "".join(c for c in own if c.isalpha()), "." + "".join(c for c in own if not c.isalpha())


@cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    _, letters, others = _symbols()
    for a in letters:
        for b in others:
            found.add_word(b + a, _BEGIN)
            found.add_word(a + b, _END)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(sentinel, _SENTINEL)
    found.make_automaton()
    return found


class Units:
    """The units of a text: how many (n), whether a sentinel is among them, and where each ends."""

    def __init__(self, text: str, block: int = BLOCK):
        table, letters, _ = _symbols()
        # a character that isn't ASCII becomes one other byte, so places are code points; the text begins behind what is no letter
        line = "." + text.encode("ascii", "replace").translate(table).decode("ascii")
        parts = []
        for start in range(0, len(line), block):
            # two characters more, as a sentinel may begin before the block
            seen = automaton().iter(line, max(0, start - 2), min(len(line), start + block))
            events = np.fromiter(chain.from_iterable(seen), np.int64).reshape(-1, 2)
            parts.append(events[events[:, 0] >= start])
        events = np.concatenate(parts)
        places, kinds = events[:, 0] - 1, events[:, 1]
        begins, ends = places[kinds == _BEGIN], places[kinds == _END]
        if line[-1] in letters:
            ends = np.append(ends, len(text))
        lengths = ends - begins
        self.ends = ends
        #: Units up to the end of each run of letters.
        self.upto = ends - np.cumsum(lengths) + np.arange(1, len(ends) + 1)
        self.n = len(text) - int(lengths.sum()) + len(ends)
        self.sentinel = bool((kinds == _SENTINEL).any())

    def place(self, k: int) -> int:
        """Characters in the first k units."""
        runs = int(np.searchsorted(self.upto, k, "right"))
        return int(self.ends[runs - 1]) + k - int(self.upto[runs - 1]) if runs else k


def cut(doc_id: int | None, text: str, seed: int = SEED, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) of a document."""
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(said[k : k + 8], 16) for k in range(0, 32, 8))
    units = Units(text)
    if not text or units.sentinel or h3 % 100 >= changed:
        return units.n, "plain", None, None, text
    first, second = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.place(first), units.place(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return units.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, seed: int = SEED, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """SCHEMA's columns of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, "text")):
            ids = batch.column(0).to_pylist()
            made = [cut(k, x or "", seed, changed, suffix_first) for k, x in zip(ids, batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*made, strict=True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: no part holds a sentinel, so sentinels part it."""
    inside = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    psm, spm = F.split(inside, f"{SUFFIX}|{MIDDLE}"), F.split(inside, f"{PREFIX}|{MIDDLE}")
    part = lambda x, *k: F.concat(*[F.get(x, F.lit(i)) for i in k])
    return F.when(form == "psm", part(psm, 0, 2, 1)).when(form == "spm", part(spm, 1, 2, 0)).otherwise(output)


ORACLE_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS k FROM d),
c AS (SELECT *, CAST(len(w) AS BIGINT) AS n, least(k[1] % (len(w) + 1), k[2] % (len(w) + 1)) AS a, greatest(k[1] % (len(w) + 1), k[2] % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR k[3] % 100 >= {CHANGED} THEN 'plain' WHEN k[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
