"""Edge cases of single operators: damaged archives, many spans, short training texts, second implementations of the classifiers."""

import random
import zlib
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from florilege.llm import embeddings, language, queries, secrets, toxicity, warc

DATA = Path("/root/testdata/sf0.001")


def test_cut_archives_are_reported(spark, tmp_path):
    rng = random.Random(1)
    pages = spark.createDataFrame([(k, "u", "".join(chr(rng.randrange(32, 500)) for _ in range(3000))) for k in range(5)], "page_id long, url string, html string").coalesce(1)
    for name in ("payload", "sha", "first", "p", "s", "path"):
        pages = pages.withColumn(name, F.lit(1))
    folder = f"file://{tmp_path}"
    files = warc.write(pages, folder)
    path = Path(files.first()["path"])
    whole = path.read_bytes()
    assert warc.read(files, folder).count() == 5
    ends = [i for i in range(len(whole)) if whole[i : i + 3] == warc.MAGIC]
    for cut in (40, 8, 1, len(whole) - ends[4] - 3, 2000):
        path.write_bytes(whole[:-cut])
        damaged = files.withColumn("bytes", F.lit(len(whole) - cut).cast("long"))
        for split in (1 << 20, 700)[: 1 if cut == len(whole) - ends[4] - 3 else 2]:
            with pytest.raises(Exception, match="breaks off|after the last record|begin in"):
                warc.read(damaged, folder, split).collect()


def test_cut_archives_of_the_listed_size_are_reported(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"page {k} " * 500) for k in range(5)], "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}"
    files = warc.write(pages, folder)
    path, starts = Path(files.first()["path"]), files.first()["starts"]
    whole = path.read_bytes()
    assert len(starts) == files.first()["records"] == 5
    for cut in (10, 1, len(whole) - starts[4], len(whole) - starts[3]):
        path.write_bytes(whole[:-cut])
        true_size = files.withColumn("bytes", F.lit(len(whole) - cut).cast("long"))
        for split in (1 << 20, 60):
            for listed in (files, files.drop("starts"), true_size):
                with pytest.raises(Exception, match="Damaged"):
                    warc.read(listed, folder, split).collect()
    path.write_bytes(whole)
    assert warc.read(files, folder, 60).count() == warc.read(files.drop("starts"), folder, 60).count() == 5


def test_folders_without_a_scheme_are_on_the_default_file_system(spark, tmp_path):
    class Said:
        def __init__(self, scheme):
            self.conf = spark._jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
            self.conf.set("fs.defaultFS", scheme)

        def hadoopConfiguration(self):
            return self.conf

    class Session:
        _jvm = spark._jvm

        def __init__(self, scheme):
            self._jsc = Said(scheme)

    assert warc.qualified(Session("file:///"), "/shared/x") == "file:///shared/x"
    assert warc.qualified(Session("viewfs://store/"), "file:/a") == warc.qualified(spark, "file:///a") == "file:///a"
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    assert warc.round_trip(spark, pages, str(tmp_path)).count() == 1


def test_members_larger_than_a_fetch(monkeypatch):
    import io

    monkeypatch.setattr(warc, "FETCH_BYTES", 64)
    rng = random.Random(2)
    raw = [warc.record(k, "u", bytes(rng.randrange(256) for _ in range(rng.randrange(2000))), None, False) for k in range(30)]
    file = b"".join(raw)
    starts = np.cumsum([0, *map(len, raw)])
    for cuts in ([0, len(file)], [0, *sorted(rng.sample(range(1, len(file)), 40)), len(file)]):
        got = [warc.parse(m)["page_id"] for a, b in zip(cuts, cuts[1:], strict=False) for m in warc.members(io.BytesIO(file), len(file), a, b)]
        assert got == list(range(30)) and len(starts) == 31


def test_s3_schemes(monkeypatch):
    class Files:
        class FileSystem:
            from_uri = staticmethod(lambda uri: (None, uri))

    monkeypatch.setattr("florilege.operators.stored.fs", Files)
    assert [warc.opened(f"{x}://bucket/a")[1] for x in ("s3", "s3a", "s3n", "hdfs")] == ["s3://bucket/a"] * 3 + ["hdfs://bucket/a"]


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_secret_base_columns_against_sql(spark):
    con = duckdb.connect()
    extra = "(900001, 'PassWord = \"abcdef1\" x TOKEN:abc apikey=zzzzzz api_key:  ''q1w2e3'' é AKIA' || repeat('A1', 9) || ' ' || repeat('0a', 13))"
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, text FROM '{DATA}/documents.parquet' UNION ALL SELECT * FROM (VALUES {extra}, (900002, NULL), (900003, ''))")
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    docs = spark.createDataFrame(con.execute("SELECT doc_id, text FROM documents").df().astype({"text": object}).where(lambda d: d.notna(), None))
    got = sorted(tuple(r[n] for n in names) for r in secrets.find(docs).collect())
    assert got == sorted(con.execute(secrets.BASE_SQL).fetchall()) and sum(g[1] for g in got) >= 3


def test_secrets_with_many_spans_and_clashing_columns(spark):
    text = "token = 'abcdefgh' and " * 20_000
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    for name in ("spans", "n_assign", "n_novel"):
        docs = docs.withColumn(name, F.lit("x"))
    assert [r["n_assign"] for r in secrets.find(docs).collect()] == [20_000] * 2


def test_short_training_texts_are_learned(spark):
    rows = [(k, "ein kurzer text" if k % 2 else "a short english", "de" if k % 2 else "en") for k in range(40)] + [(90, "...", "xx")]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r["lang_pred"] == dict((a, c) for a, _, c in rows)[r["doc_id"]] for r in got if r["doc_id"] < 90)
    assert [r["lang_pred"] for r in got if r["doc_id"] == 90] == ["und"]


def test_nearest_centroid_by_hand(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(("the cat sat", "and so on", "der hund lief", "und so weiter")[2 * (k % 2) :][:2]) for _ in range(rng.randrange(3, 30))), "de" if k % 2 else "en") for k in range(80)]
    rows.append((500, "der hund " * 60_000, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    for doc_id, text, _ in rows:
        clean = "".join(c if "a" <= c <= "z" else " " for c in text.lower())
        counts = np.zeros(language.DIMENSIONS)
        for order in (2, 3, 4):
            for i in range(len(clean) - order + 1):
                gram = clean[i : i + order]
                if gram[:2] == "  ":
                    continue
                code = 0
                for c in gram:
                    code = (code * 257 + ord(c)) % (1 << 32)
                counts[(((code + order) * 2654435761) % (1 << 32)) >> 20] += 1
            if len(clean) > 10_000:
                break
        if len(clean) > 10_000:
            continue
        x = np.sqrt(counts) * model.idf
        cosines = [float(x @ c) / max(float(np.sqrt(x @ x)), 1e-12) for c in model.centroids.astype(float)]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert got[doc_id]["lang_pred"] == model.languages[best] and abs(got[doc_id]["score"] - min(1.0, cosines[best])) < 1e-4
    assert got[500]["lang_pred"] == "de"


def test_ftrl_by_hand(monkeypatch):
    """The vectorised learner against the update rule written out, one coordinate at a time."""
    monkeypatch.setattr(toxicity, "L1", 0.3)
    rng = random.Random(4)
    examples = [np.array(sorted(rng.sample(range(40), rng.randrange(0, 9))), np.int64) for _ in range(60)]
    labels = np.array([float(3 in x.tolist()) for x in examples])
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == toxicity.SLOTS else 0.3
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(examples)):
            at = [*examples[k].tolist(), toxicity.SLOTS]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - labels[k]
            for i in at:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    slots, weights, bias = toxicity.ftrl(examples, labels)
    expected = {i: weight(i) for i in z if i != toxicity.SLOTS and weight(i)}
    assert slots.tolist() == sorted(expected) and np.allclose(weights, [expected[i] for i in slots.tolist()]) and abs(bias - weight(toxicity.SLOTS)) < 1e-9


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    """Documents of the fold that wasn't learned from."""
    docs = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/../sf0.01/labels.parquet")
    sf_dir = str(DATA.parent / "sf0.01")
    said = queries.op9_language(spark, sf_dir).where("held_out AND lang_pred <> 'und'").join(docs.where("lang IS NOT NULL"), "doc_id")
    assert said.where("lang = lang_pred").count() >= 0.99 * said.count() > 100
    scored = queries.op7_toxicity(spark, sf_dir).where("held_out").join(labels, "doc_id")
    assert scored.where("toxic = 0 AND predicted = 1").count() <= 0.02 * scored.where("toxic = 0").count()
    assert scored.where("toxic = 1 AND predicted = 1").count() >= 0.6 * scored.where("toxic = 1").count()


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(None, "you scum"), (1, ""), (1, ""), (2, "word " * 200_000)], "doc_id long, text string")
    for name in ("score", "predicted", "held_out", "toxic"):
        docs = docs.withColumn(name, F.lit("x"))
    model = (np.array([5]), np.array([1.0]), -1.0)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 4 and rows[1] == rows[2] and rows[0]["held_out"] is False
    assert toxicity.score(docs.limit(0), model).count() == 0 and zlib.crc32(b"1") % 4 == 3 and not rows[1]["held_out"]
    assert len(toxicity.features(pa.array([None, "", "a b"]))[0]) == 3


def exact_links(vectors, threshold=Fraction(9, 10)):
    """Links by exact arithmetic: cosine >= threshold as squares of fractions."""
    links = [0] * len(vectors)
    exact = [[Fraction(x) for x in v] for v in vectors]
    for i in range(len(exact)):
        for j in range(i):
            dot = sum(a * b for a, b in zip(exact[i], exact[j], strict=True))
            if dot > 0 and dot * dot >= threshold**2 * sum(a * a for a in exact[i]) * sum(b * b for b in exact[j]):
                links[i] += 1
                links[j] += 1
    return links


@pytest.mark.parametrize("more", [0, 3000])
def test_vectors_of_any_scale(spark, more):
    rng = random.Random(4)
    base = [[1.0, 2.0, 3.0, -1.0, 0.5, 0.25, 2.0, 1.0], [-3.0, 1.0, 0.0, 2.0, 1.0, 1.0, -1.0, 0.0]]
    scales = (1.0, 1e-170, 1e-200, 1e200, 1e307 / 4, 2.0**-1060)
    vectors = [[x * s for x in v] for v in base for s in scales]
    small = exact_links(vectors)
    # others are far from them: none has a cosine of 0.9 with either
    while len(vectors) < len(base) * len(scales) + more:
        v = [rng.gauss(0, 1) for _ in range(8)]
        if all(abs(np.dot(v, b)) < 0.85 * np.linalg.norm(v) * np.linalg.norm(b) for b in base):
            vectors.append(v)
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(rows).collect()}
    assert [got[k]["n_links"] for k in range(len(small))] == small == [len(scales) - 1] * len(small)
    assert [got[k]["component_id"] for k in range(len(small))] == [0] * len(scales) + [len(scales)] * len(scales)
