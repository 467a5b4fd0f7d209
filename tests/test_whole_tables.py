"""Queries that took a part of their table, or a smaller table, over the whole one."""

import json
from pathlib import Path

import pytest

from florilege import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


def test_plan_of_all_customers(spark, tmp_path, monkeypatch):
    from florilege.plans import sourced

    monkeypatch.setattr(sourced, "_place", lambda spark, name: f"{tmp_path}/{name}")
    catalogue.QUERIES["written_plan"](spark, str(DATA)).collect()
    planned = [json.loads(x) for p in (tmp_path / "plan" / "plan").glob("*.json") for x in p.read_text().splitlines()]
    customers = spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey", "c_name").collect()
    assert sorted((r["k"], r["name"]) for r in planned) == sorted(map(tuple, customers))


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_similar_terms_of_documents_against_brute_force(spark, tmp_path):
    counts = {"liberdade": 3, "liberdades": 1, "liberdabe": 1, "folha": 2, "folga": 1, "fonte": 30, "fonts": 1, "arquivo": 1, "arquive": 1, "colecoes": 2, "coleccoes": 5, "museu": 2, "musa": 9}
    text = [w for w, n in counts.items() for _ in range(n)]
    spark.createDataFrame([(k, " ".join(text[k::4])) for k in range(4)] + [(4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    terms = {t: n for t, n in counts.items() if 5 <= len(t) <= 24 and n <= 20}
    expected, seen = set(), set()
    for a, n in sorted(terms.items(), key=lambda x: (x[1], x[0])):  # the rarest picks first; a pair comes once
        found = []
        for b, m in terms.items():
            d = _distance(a, b)
            if a != b and a[:2] == b[:2] and d in (1, 2) and max(n, m) >= 2 and (len(a) >= 8 or d == 1) and frozenset((a, b)) not in seen:
                found.append((d, -abs(n - m), b, m))
        if found:
            d, _, b, m = min(found)
            expected.add((a, n, b, m, d))
            seen.add(frozenset((a, b)))
    got = catalogue.QUERIES["similar_terms"](spark, str(tmp_path)).collect()
    assert len(expected) == 4 and {(r["term"], r["n"], r["other"], r["other_n"], r["distance"]) for r in got} == expected


def test_words_of_documents_are_folded(spark, tmp_path):
    spark.createDataFrame([(1, "Museológico arquivo"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["word"] for r in catalogue.QUERIES["folded_terms"](spark, str(tmp_path)).collect()} == {"Museológico", "arquivo"}
