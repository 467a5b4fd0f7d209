"""The queries of this subpackage: each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.llm import bpe, decontamination, divergence, embeddings, fim, html_text, jaccard, language, packing, pii, secrets, toxicity, warc
from florilege.llm.common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.group(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array_join(F.transform("scores", lambda x: x.cast("decimal(3,2)").cast("string")), ",")
    return pii.find(table(spark, sf_dir, "documents")).withColumn("scores", listed)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.decode(bpe.encode(docs, tokenizer_path, packed=True).drop("text"), tokenizer_path)
    ids, text = F.sha2("ids", 256), F.sha2(F.col("text").cast("binary"), 256)
    return back.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), ids.alias("ids_sha256"), text.alias("decoded_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_secrets": op2_secrets,
    "op3_decontamination": op3_decontamination,
    "op4_warc": op4_warc,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_pii": op8_pii,
    "op9_language": op9_language,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_bpe": op11_bpe,
    "op12_source_divergence": op12_source_divergence,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": decontamination.ORACLE_SQL,
    "op4_warc": warc.ORACLE_SQL,
    "op5_embedding_dedup": embeddings.ORACLE_SQL,
    "op6_jaccard_join": jaccard.ORACLE_SQL,
    "op8_pii": pii.ORACLE_SQL,
    "op12_source_divergence": divergence.ORACLE_SQL,
    "op13_fill_in_middle": fim.ORACLE_SQL,
}
