"""A corpus, cleaned and packed: toxic texts go, one document of each near-duplicate class stays, contaminated
documents go, secrets are redacted, and what is left is packed into sequences.

Defined results: null and empty texts score as texts without matches, are each their own class, are not contaminated,
hold no secrets and pack as the end id alone; rows without doc_id stay, each by itself; repeated rows leave one row,
and different texts of one doc_id each stay unless they are near copies; of a class the smallest doc_id stays; an
empty table gives an empty result; further columns of the documents are carried by all stages but the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filingmill.llm import decontamination, minhash, packing, secrets, toxicity
from filingmill.llm.common import scratch, stored, table
from filingmill.llm.queries import tokenizer_path

#: SQL cannot say these stages; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):  # what a stage stores in between goes once its result is written
            docs = stored(stage(spark, docs, sf_dir), name, result=True)
    return docs
