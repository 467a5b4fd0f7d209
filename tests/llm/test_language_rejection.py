"""What language identification rejects by distance: texts in languages that it hasn't learned, code and junk, but no clean text."""

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from florilege.llm import language

DATA = Path("/root/testdata/sf0.01")
#: The same sentence in languages that aren't learned.
UNSEEN = {
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "sw": "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu.",
}
JUNK = {
    "code": "def main(args):\n    for k, v in sorted(args.items()):\n        print(f'{k}={v}')\n    return [x ** 2 for x in range(10) if x % 2]",
    "consonants": " ".join("".join(random.Random(k).choice("bcdfghjklmnpqrstvwxz") for _ in range(3 + k % 6)) for k in range(30)),
    "digits": "0x1f 77 a 9 8 7 6 5 4 3 2 1 0 b 42 42 42 42 42 42 42 42 c 42 42 42",
}


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_foreign_texts_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.train(docs)
    extra = [*UNSEEN.values(), *JUNK.values()]
    names = [*UNSEEN, *JUNK]
    rows = spark.createDataFrame(list(enumerate(extra)), "doc_id long, text string")
    rejected = {names[r["doc_id"]]: r["rejected"] for r in language.predict(rows, model).collect()}
    assert all(rejected.values()), rejected
    found = language.predict(docs, model).where("rejected AND held_out").count()
    assert found <= 0.01 * docs.where(language.held_out()).count()
    # words that short texts are made of are known too
    words = [w for x in pq.read_table(DATA / "documents.parquet")["text"].to_pylist()[:200] for w in (x or "").split(".")[:1] if w.isascii() and w.replace(" ", "").isalpha()]
    short = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "doc_id long, text string")
    assert language.predict(short, model).where("rejected").count() <= 0.02 * len(words)


def test_what_is_usual_follows_length():
    import numpy as np
    import pyarrow as pa

    texts = ["the cat and the dog ran over the hill and far away into the wood " * k for k in range(1, 12)]
    idf = np.ones(language.DIMENSIONS, np.float32)
    centre = language.clustered(language.vectors(language.counts(pa.array(texts)), idf), 2)
    found = language.usual(texts, centre, idf)
    assert len(found) == len(language.SIZES) and found[0] < found[2] < found[-1] <= 1.001
    assert language.usual([], centre, idf) == [0.0] * len(language.SIZES)
    assert language.usual(["ab"], centre, idf) == [0.0] * len(language.SIZES)
    assert language.cut("äöü" * 50, 31).strip("äöü") == "" and len(language.cut("äöü" * 50, 31).encode()) <= 31
