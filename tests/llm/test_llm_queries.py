"""The registered queries over the smallest tables: against their SQL where they have one, and the pipeline stage by stage."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from florilege.llm import decontamination, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    result = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == expected


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(DATA))
        assert after.columns == docs.columns
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        if name == "benchmark_decontamination":
            assert {r["doc_id"] for r in decontamination.find(docs, bench).collect()} == {r["doc_id"] for r in docs.collect()} - ids
        kept[name], docs = ids, after
    assert len(kept["language_id"]) >= 198 and kept["pii"] == kept["benchmark_decontamination"] < kept["ngram_jaccard_join"] < kept["language_id"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA))
    assert {r["doc_id"] for r in packed.collect()} == kept["pii"]
    assert corpus_pipeline.run(spark, str(DATA)).count() == packed.count()
