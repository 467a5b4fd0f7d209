"""BPE against the tokenizers library, fill-in-middle and the source audit against plain versions, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from florilege.llm import bpe, divergence, fim, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# -- BPE


def odd_texts(rng, n):
    for _ in range(n):
        kind = rng.randrange(6)
        if kind == 0:
            yield "".join(rng.choice("aeths nio'rd ") for _ in range(rng.randrange(60)))
        elif kind == 1:
            yield "".join(chr(rng.randrange(32, 127)) for _ in range(rng.randrange(80)))
        elif kind == 2:
            yield "".join(chr(rng.choice([rng.randrange(1, 0x300), rng.randrange(0x300, 0xD800), rng.randrange(0xE000, 0x110000), 32, 10])) for _ in range(rng.randrange(50)))
        elif kind == 3:
            yield rng.choice(["a", "th", "-", "=", "\n", " ", "é", "\r\n"]) * rng.randrange(200)
        elif kind == 4:
            yield " ".join(rng.choice(["the", "Internationalization", "don't", "<|endoftext|>", "  ", "\n\n", "x" * rng.randrange(40), "1234567"]) for _ in range(rng.randrange(30)))
        else:
            yield "".join(rng.choice(["er", "in", "tion", "ing", " the", "en", "é", "ß", "ou", " "]) for _ in range(rng.randrange(40)))


def test_bpe_is_the_library():
    library, encoder = Tokenizer.from_file(PATH), bpe.Encoder(bpe.compiled(PATH))
    for text in [*odd_texts(random.Random(5), 8000), "a" * 20_000, "ab " * 5000, " " * 5000 + "x"]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == ids, text[:80]
        assert bpe.joined_labels(bpe.compiled(PATH).labels, np.array(ids, int)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_bpe_words_split_as_the_library_splits_them():
    """Every character between letters, digits, signs and spaces: where Python's tables don't know it, the library splits."""
    from tokenizers.pre_tokenizers import ByteLevel

    encoder, splitter = bpe.Encoder(bpe.compiled(PATH)), ByteLevel(add_prefix_space=False)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 4096):
        known = "\n".join(f"a{c} {c}1{c}!{c}  {c}" for c in map(chr, points[start : start + 4096]) if bpe.unicodedata.category(c) != "Cn")
        assert encoder.split(known) == [known[a:b] for _, (a, b) in splitter.pre_tokenize_str(known)]


def test_bpe_pieces_and_caches_change_nothing(monkeypatch):
    whole, parted = bpe.Encoder(bpe.compiled(PATH)), bpe.Encoder(bpe.compiled(PATH))
    texts = list(odd_texts(random.Random(6), 300))
    text = " ".join(texts)
    expected = whole.ids(text)
    monkeypatch.setattr(bpe, "PIECE", 50)
    monkeypatch.setattr(bpe, "CACHE_WEIGHT", 400)
    monkeypatch.setattr(bpe, "TABLE_ENTRIES", 30)
    assert len(list(parted.pieces(text))) > 50 and "".join(parted.pieces(text)) == text
    assert parted.ids(text) == expected


def test_automaton_accepts_one_path_for_each_string():
    """All token sequences over a small vocabulary: the automaton accepts exactly those that merging leads to."""
    from itertools import product

    merges = [("a", "b"), ("a", "a"), ("ab", "a"), ("b", "ab"), ("aa", "aa"), ("aba", "b"), ("b", "b"), ("aa", "b")]
    tokens = ["a", "b", *dict.fromkeys(x + y for x, y in merges)]
    vocabulary = {t: k for k, t in enumerate(tokens)}
    machine = bpe.Automaton(vocabulary, merges, {})

    def merged(word):
        parts = list(word)
        for x, y in merges:
            k = 0
            while k + 1 < len(parts):
                if parts[k] == x and parts[k + 1] == y:
                    parts[k : k + 2] = [x + y]
                k += 1
        return parts

    encoder = bpe.Encoder(machine)
    for n in range(1, 9):
        for word in map("".join, product("ab", repeat=n)):
            ids = np.frombuffer(encoder.word(word.encode()), "<u4").tolist()
            assert [tokens[k] for k in ids] == merged(word)
    live = {machine.token[k] for k in range(1, len(machine.token))} - {-1}
    for n in range(1, 5):
        for path in product(live, repeat=n):
            accepted = all(machine.passes(a, b) for a, b in zip(path, path[1:], strict=False))
            assert accepted == (merged("".join(tokens[k] for k in path)) == [tokens[k] for k in path])


def test_bpe_rejects_other_files(tmp_path):
    with pytest.raises(ValueError):
        bpe.compiled(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError):
        bpe.Automaton({"a": 0, "b": 1, "ab": 2}, [("a", "b"), ("a", "b")], {})


def test_bpe_columns_and_nulls(spark):
    rows = [(1, None, "x"), (None, "", "y"), (3, "two words", "z"), (3, "two words", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bpe.encode(docs, PATH, ids="IDs".lower())
    assert coded.columns == ["doc_id", "text", "ids"]
    back = bpe.decode(coded.withColumnRenamed("text", "was"), PATH)
    got = sorted(((r["doc_id"], r["was"], len(r["ids"]), r["text"]) for r in back.collect()), key=repr)
    assert got == sorted([(1, None, 0, ""), (None, "", 0, ""), (3, "two words", 2, "two words"), (3, "two words", 2, "two words")], key=repr)
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).collect() == []
    for kind in ("array<int>", "binary"):
        null = spark.createDataFrame([(1, None)], f"doc_id long, ids {kind}")
        assert bpe.decode(null, PATH).collect()[0]["text"] is None


def test_bpe_query_is_the_library(spark):
    library = Tokenizer.from_file(PATH)
    texts = [*odd_texts(random.Random(8), 400), None, ""]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]

    class Session:
        class read:
            parquet = staticmethod(lambda path: spark.createDataFrame(rows, DOCS))

    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_bpe(Session, "x").collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert got[k] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
    docs = spark.createDataFrame(rows, DOCS)
    plain = {r["doc_id"]: (r["ids"], r["text"]) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert all(plain[k][0] == library.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts))


# -- fill-in-middle


def units(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text)


def plain_cut(doc_id, text):
    said = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(said[8 * k : 8 * k + 8], 16) for k in range(4)]
    w = units(text)
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(w), "plain", None, None, text
    prefix, middle, suffix = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h[3] % 100 < 20:
        return len(w), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(w), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def fim_texts(rng, n):
    for _ in range(n):
        yield "".join(rng.choice(["a", "Zb", " ", "é", "😀", "<", ">", "P", "S>", "<M", "\n", "\0", "7", "P>"]) for _ in range(rng.randrange(30)))


def test_fim_units_are_found_by_events():
    for text in fim_texts(random.Random(2), 3000):
        w = units(text)
        for block in (1, 2, 3, 7, 1 << 18):
            found = fim.Units(text, block)
            assert found.n == len(w)
            assert found.sentinel == any(x in text for x in ("<P>", "<S>", "<M>"))
            assert [found.place(k) for k in range(len(w) + 1)] == [len("".join(w[:k])) for k in range(len(w) + 1)]


def test_fim_against_a_plain_version(spark):
    texts = [*fim_texts(random.Random(3), 1500), "", "<P", "x<S>y", "word " * 100_000]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOCS)
    made = fim.transform(docs)
    got = {r["doc_id"]: r for r in made.withColumn("back", fim.restored(made["output"], made["form"])).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_cut(k, t)
        assert r["back"] == t
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_fim_nulls_and_clashing_columns(spark):
    rows = [(None, "some words", 1), (None, "some words", 1), (5, None, 2)]
    made = fim.transform(spark.createDataFrame(rows, "doc_id long, text string, output int")).collect()
    assert made[0] == made[1] and made[2]["form"] == "plain" and made[2]["n"] == 0 and made[2]["output"] == ""
    assert fim.transform(spark.createDataFrame([], DOCS)).collect() == []


# -- the audit of sources


def plain_audit(rows, least=10, listed=10):
    docs = [(x or "", a or "", s or "") for x, a, s in rows]
    words = [Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in x))) for x, _, _ in docs]
    out = []
    for lang in {a for _, a, _ in docs}:
        held = Counter(w for k, (_, a, _) in enumerate(docs) if a == lang for w in words[k])
        kept = sorted((w for w, n in held.items() if n >= least), key=lambda w: w.encode())
        counts = defaultdict(Counter)
        for k, (_, a, s) in enumerate(docs):
            if a == lang:
                counts[s].update({w: n for w, n in words[k].items() if held[w] >= least})
        whole = sum(counts.values(), Counter())

        def share(c):
            total = sum(c.values()) + 2 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 2) // total for w in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pairs = sorted(((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in counts if o != s))
            out += [(lang, s, "pair", o, -v, r + 1) for r, (v, _, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w])
            out += [(lang, s, "term", w, -v, r + 1) for r, (v, _, w) in enumerate(terms[:listed])]
    return sorted(out)


def audited(df, **options):
    return sorted(tuple(r) for r in divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_against_a_plain_version(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = ["the", "The", "été", "Été", "zoë", "a", "ß", "naïve", "x", "ÉTÉ", "日本", "😀"] + [f"{a}{b}" for a in "abcdeé" for b in "uvwxyz"]
    rows = [(rng.choice([None, "", "1 2 3"]) if rng.random() < 0.1 else " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40))) + rng.choice(["", "!", "_q9", "\0é"]), rng.choice(["en", "en", "fr", None, ""]), rng.choice(["a", "b", "é", "Z", None, "ab"])) for _ in range(400)]
    rows += [("only here", "de", "one"), (None, "it", "p"), ("", "it", "q")]
    docs = spark.createDataFrame([(None, x, a, s, "clash") for x, a, s in rows], "doc_id long, text string, lang string, source string, term string")
    expected = plain_audit(rows)
    assert audited(docs) == expected and any(r[2] == "term" for r in expected) and ("it", "p", "pair", "q", 0, 1) in expected
    monkeypatch.setattr(divergence, "CELLS", 20)
    monkeypatch.setattr(divergence, "STEP_BYTES", 200)
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for pairs in (1 << 22, 50, 4):  # sums of all languages, of some, and of none are held
            monkeypatch.setattr(divergence, "PAIRS", pairs)
            assert audited(docs) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert audited(docs, least=30, listed=2) == plain_audit(rows, 30, 2)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_shares_are_exact():
    for count, total in ((0, 7), (5, 9), (10**12, 3 * 10**13 + 1), (8 * 10**15 - 3, 9 * 10**15 - 1)):
        assert divergence.shares(np.array([count]), total).tolist() == [1 + 10**9 * (count + 2) // total]
