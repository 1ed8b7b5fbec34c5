"""The registered queries of this subpackage and the SQL that returns the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import classifier, embed_lsh, html, langid, line_dedup, merkle, minhash, mixing, packing, quality_rules, search, suffix_dedup, warc
from rivulet.llm.common import id_mod
from rivulet.llm.oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

SEQUENCE = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.line_rule(table(spark, sf_dir, "documents"), percent=quality_rules.PERCENT)


def op1_line_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.line_rule(table(spark, sf_dir, "documents"), max_documents=quality_rules.MAX_DOCUMENTS)


def op1_line_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.line_rule(table(spark, sf_dir, "documents"), percent=quality_rules.PERCENT)


def op1_remaining_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.line_rule(table(spark, sf_dir, "documents"), percent=quality_rules.PERCENT, also=("remaining_text",))
    return out.select("doc_id", "n_removed_words", "kept", F.md5(F.col("remaining_text").cast("binary")).alias("remaining_md5"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_lsh.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = id_mod(F.col("doc_id"), 5)
    model = classifier.train(docs, labels.filter(part != 0))
    return classifier.score(docs, model).select("doc_id", (part == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_spans", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = id_mod(F.col("doc_id"), 3)
    model = langid.train(docs.filter(part != 1))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (part == 1).alias("held_out"), "lang_pred", "score")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.cut(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), SEQUENCE, END_ID)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), SEQUENCE)


def op11_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.verified(merkle.proofs(table(spark, sf_dir, "documents"), tampered=tampered))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op1_line_limit, op1_line_share, op1_remaining_text, op2_minhash_near_dedup, op3_embedding_near_dedup, op4_quality_classifier, op5_line_dedup, op6_suffix_dedup, op7_language_id, op8_html_extraction, op9_source_mixing, op10_best_fit_packing, op11_warc_packages, op12_ranked_search, op13_merkle_manifest)
}
