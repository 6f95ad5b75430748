"""A corpus pipeline: toxicity, exact dedup, near dedup, decontamination, subword encoding.

Every stage takes a whole table, with nulls in any column, empty and very long texts, repeated rows and empty tables; rows
are judged and dropped by their own id and text, columns of any name are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contrasta.llm.decontaminate import drop_leaks
from contrasta.llm.exact_dedup import keep_last
from contrasta.llm.ngram_jaccard import keep_one
from contrasta.llm.sentencepiece_codec import default_model, encode_decode
from contrasta.llm.shared import discard, stash, tidy
from contrasta.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; null and empty texts stay."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays, null ids being smallest; null and empty texts are equal; of a repeated row one stays."""
    return keep_last(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id stays, null ids being largest; texts without words stay."""
    return keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go; without items all stay."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and the text decoded from them; a null text counts as empty and has the end id alone."""
    return encode_decode(docs, default_model())


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("n-gram Jaccard join", near), ("decontamination", decontaminated), ("SentencePiece", encoded)]
#: SQL can't express the first and last stage; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each but the last is written and reread; what it was made from is removed then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
        tidy(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
