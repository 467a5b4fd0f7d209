"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the sequences that the merges lead to, one for each string. It is compiled from
one state that lets every byte pass, a merge gadget at a time: for a merge of u and v, arcs of u are led to a copy of their
target that has lost its arc of v, and what could take u then v gets an arc of the new token to where v led. As all arcs of a
token end in one state, a state is kept as the arc that its gadget cut, and a row of the transition table is filled in when it
is first asked for.

A pre-split word is run through the table: each of its places is reached by one path only, so the token that ends there is
found once. Decoding joins the labels of arcs.

Defined results: null and empty texts have no ids; the strings of special tokens in a text are those tokens; words may be of any
length, in a time that grows with it; an empty table gives an empty one; repeated rows, null ids and clashing columns are passed
through (encode and decode add one column and keep all others); ids that the vocabulary lacks fail the job; null ids decode as
null. Bytes that are no UTF-8 are decoded as replacement characters.
"""

from __future__ import annotations

import json
import math
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType

from florilege.llm.common import chunks, release

#: Weight of a generation of a task's cached words (letters and a constant each), entries of its transition table, letters of a
#: text that are split at once, and rows that are decoded at once.
CACHE_WEIGHT, TABLE_ENTRIES, PIECE, ROWS = 4 << 20, 1 << 19, 1 << 20, 256
#: Fixed value: the splitter of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """The compiled merges of a tokenizer file; small (its size is the vocabulary's), so it is sent to every task."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        letters = byte_letters()
        size = 1 + max([*vocabulary.values(), *special.values()], default=-1)
        self.labels: list[bytes | None] = [None] * size
        for name, token in vocabulary.items():
            self.labels[token] = bytes([letters[x] for x in name])
        for name, token in special.items():
            self.labels[token] = name.encode()
        self.special, self.size = dict(special), size
        #: A token's halves and the merge that makes it, none for bytes; the state that its arcs lead to.
        self.left, self.right, self.step = [-1] * size, [-1] * size, [-1] * size
        self.target = [0] * size
        #: Which arc each gadget cut: (token whose arcs it led elsewhere, token of the cut arc) -> merge.
        self.cuts: dict[int, int] = {}
        self.states = 1
        alive = {vocabulary[x] for x in letters if x in vocabulary}
        for k, (a, b) in enumerate(merges):
            u, v, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if made in alive or self.step[made] >= 0:
                raise ValueError(f"two merges make {a + b!r}")
            if u in alive and v in alive and self.passes(u, v):
                self._merge(k, u, v, made)
                alive.add(made)
            elif any(len(self.labels[x]) > 1 and x not in alive and self.step[x] < 0 and self._comes_later(merges, vocabulary, x, k) for x in (u, v)):
                raise ValueError(f"{a!r} and {b!r} are merged before they are made")
        self.goto, self.token = self._trie(alive)

    @classmethod
    def of(cls, tables: dict) -> Automaton:
        """An automaton of the plain tables (vars) that were sent."""
        made = cls.__new__(cls)
        vars(made).update(tables)
        return made

    @staticmethod
    def _comes_later(merges: list[tuple[str, str]], vocabulary: dict[str, int], token: int, k: int) -> bool:
        return any(vocabulary[a + b] == token for a, b in merges[k:])

    def _merge(self, k: int, u: int, v: int, made: int) -> None:
        """The gadget: a copy of u's target without an arc of v; arcs of the new token end where v's do."""
        self.left[made], self.right[made], self.step[made] = u, v, k
        self.target[made] = self.target[v]  # read first: u may be v, and then it is the state that still has the arc
        self.cuts[u * self.size + v] = k
        self.target[u] = self.states
        self.states += 1

    def passes(self, last: int, token: int) -> bool:
        """Whether the state that arcs of `last` lead to has an arc of `token`.

        It has none if a gadget in the state's line of copies cut the arc of the token, or that of a left part of it before the
        part was merged: a state gets the arc of a merged token only where it has that of its left half.
        """
        own, before = last, math.inf  # the copies made for `own` belong to the line up to that merge
        while own >= 0:
            part, until = token, math.inf
            while part >= 0:
                k = self.cuts.get(own * self.size + part)
                if k is not None and k < before and k <= until:
                    return False
                part, until = self.left[part], self.step[part]
            own, before = self.right[own], self.step[own]
        return True

    def _trie(self, alive: set[int]) -> tuple[list[dict[int, int]], list[int]]:
        """The byte arcs of each node, and the token that ends there."""
        goto: list[dict[int, int]] = [{}]
        token = [-1]
        for t in sorted(alive):
            node = 0
            for b in self.labels[t]:
                after = goto[node].setdefault(b, len(token))
                if after == len(token):
                    goto.append({})
                    token.append(-1)
                node = after
            token[node] = t
        return goto, token


@cache
def compiled(path: str) -> Automaton:
    """The automaton of a tokenizer file with a byte-level BPE; compiled on the driver, once a path."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    model, split = said["model"], said["pre_tokenizer"]
    odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [k for k in ("lstrip", "rstrip", "single_word", "normalized") if any(t[k] for t in said["added_tokens"])]
    if model["type"] != "BPE" or odd or said["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
        raise ValueError(f"{path} holds no plain byte-level BPE {odd}")
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    return Automaton(model["vocab"], merges, {t["content"]: t["id"] for t in said["added_tokens"]})


class Encoder:
    """Encodes texts in one task."""

    def __init__(self, automaton: Automaton):
        import regex

        self.a = automaton
        self.lengths = [len(x or b"") for x in automaton.labels]
        self.longest = max(self.lengths, default=0)
        self.find = regex.compile(WORDS).findall
        names = sorted(automaton.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.table: dict[int, bool] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.weight = 0
        self.splitter = None

    def word(self, word: bytes) -> bytes:
        """Ids of a word, little-endian: the one path of the automaton that spells it. The longest arc is tried first; a place
        is reached by one path only, so arcs that led to a dead end are done with."""
        a, table = self.a, self.table
        goto, token, size, target, lengths, longest = a.goto, a.token, a.size, a.target, self.lengths, self.longest
        n = len(word)
        arcs: list[list[int] | None] = [None] * n
        path: list[int] = []
        place = row = 0
        last = -1
        while place < n:
            left = arcs[place]
            if left is None:
                left, arc = [], goto[0]
                for b in word[place : place + longest]:
                    node = arc.get(b)
                    if node is None:
                        break
                    if token[node] >= 0:
                        left.append(token[node])
                    arc = goto[node]
                arcs[place] = left
            while left:
                t = left.pop()
                passes = table.get(row + t)
                if passes is None:
                    if len(table) >= TABLE_ENTRIES:
                        table.clear()
                    passes = table[row + t] = a.passes(last, t)
                if passes:
                    path.append(t)
                    place += lengths[t]
                    break
            else:
                place -= lengths[path.pop()]
            last = path[-1] if path else -1
            row = target[last] * size if path else 0
        return struct.pack(f"<{len(path)}I", *path)

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens. Where Python's tables don't know a character, newer ones may see
        it differently, so the text is left to the tokenizers library's splitter."""
        if text.isascii() or not any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self.find(text)
        if self.splitter is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.splitter = ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def pieces(self, text: str) -> Iterator[str]:
        """Parts of a text that split on their own: a space behind what is no white space begins a word."""
        start = 0
        while len(text) - start > PIECE:
            cut = text.find(" ", start + PIECE)
            while cut >= 0 and text[cut - 1].isspace():
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[start:cut]
            start = cut
        yield text[start:] if start else text

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if not text:
            return b""
        out = []
        parts = self.special.split(text) if self.special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.array(self.a.special[part], "<u4").tobytes())
            elif part:
                out += map(self._piece, self.pieces(part))
        return b"".join(out)

    def _piece(self, text: str) -> bytes:
        words = self.split(text)
        fresh = set(words).difference(self.new)
        if self.weight > CACHE_WEIGHT:  # the words of one generation back stay
            self.old, self.new, self.weight, fresh = self.new, {}, 0, set(words)
        for w in fresh:
            known = self.old.get(w)
            self.new[w] = self.word(w.encode()) if known is None else known
            self.weight += len(w) + 16
        return b"".join(map(self.new.__getitem__, words))


def _added(schema: str, df: DataFrame, name: str) -> str:
    fields = [f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields if f.name != name]
    return ", ".join([*fields, f"{_quoted(name)} {schema}"])


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", packed: bool = False) -> DataFrame:
    """docs with the ids of their texts, as an array of int or packed in 32 bits each, the least byte first; a column of that
    name is replaced."""
    tables = docs.sparkSession.sparkContext.broadcast(vars(compiled(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Automaton.of(tables.value))
        for batch in (part for whole in batches for part in chunks(whole, text)):
            raw = [encoder.ids(x or "") for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            if packed:
                column = pa.array(raw, pa.binary())
            else:
                offsets = np.zeros(len(raw) + 1, np.int32)
                offsets[1:] = np.cumsum([len(x) // 4 for x in raw])
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(raw))])
                column = pa.ListArray.from_arrays(pa.array(offsets), values)
            kept = [k for k, n in enumerate(batch.schema.names) if n != ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), column], names=[*(batch.schema.names[k] for k in kept), ids])

    return docs.mapInArrow(run, _added("binary" if packed else "array<int>", docs, ids))


def joined_labels(labels: list[bytes | None], ids: np.ndarray) -> bytes:
    """The labels of arcs in a row."""
    return b"".join([labels[k] for k in ids.tolist()])


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with the texts of its ids, which are an array or packed; a column of that name is replaced."""
    sent = encoded.sparkSession.sparkContext.broadcast(compiled(path).labels)
    numbers = (lambda x: np.frombuffer(x.as_buffer(), "<u4")) if isinstance(encoded.schema[ids].dataType, BinaryType) else (lambda x: np.asarray(x.values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts = [joined_labels(labels, numbers(x)).decode("utf-8", "replace") if x.is_valid else None for x in batch.column(batch.schema.get_field_index(ids))]
                kept = [k for k, n in enumerate(batch.schema.names) if n != text]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(texts, pa.string())], names=[*(batch.schema.names[k] for k in kept), text])
            release()

    return encoded.mapInArrow(run, _added("string", encoded, text))
