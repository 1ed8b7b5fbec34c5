"""From documents to packed sequences: five stages, each written as Parquet and read again by the next.

Scratch tables of a stage are deleted once its result is written, and that result once the next one is. The last stage's
tables stay, since the result is read from them.

Defined cases: null, empty and letterless texts go in the first stage, whatever else is null in a row; long texts are
taken whole; ties are settled as the operators say; of rows that repeat an id one stays (rows with null id all do); an
empty table gives an empty result; further columns are carried along to the mix, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import langid, line_dedup, minhash, mixing, packing
from rivulet.llm.common import cleared, discard, id_mod, scratch, unused
from rivulet.llm.queries import END_ID, SEQUENCE, TOKENIZER, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters go."""
    model = langid.train(docs.filter(id_mod(F.col("doc_id"), 3) != 1))
    names = {"pred": unused(docs, "lang_pred"), "score": unused(docs, "score")}
    return langid.predict(docs, model, **names).filter(langid.accepted(**names)).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without later copies of three-line passages."""
    out = line_dedup.dedup(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.drop_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece in sequences of tokens."""
    pieces = packing.cut(docs, public_tokenizers.path(TOKENIZER), SEQUENCE, END_ID)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), SEQUENCE)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup), ("source_mixing", source_mixing), ("packing", packing_stage)]

#: Tokens, language scores and MinHash components are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = scratch(spark)
        with cleared(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
