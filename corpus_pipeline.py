"""Corpus pipeline: documents in, token ids of the documents that stay out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of documents.

1. toxicity            documents the factorization machine rejects go
2. quality             documents the line field rejects go
3. near_dedup          one document of each near-duplicate group stays (five-word shingles,
                       similarity 0.8 or more)
4. decontamination     documents that hold a benchmark item go
5. bpe                 (doc_id, n_tokens, ids_sha256, decoded_sha256, ids)

Both classifiers learn from the labelled rows among their own input, without the held-out
remainders of their queries.  Rows with a NULL doc_id or text are kept where a stage says
nothing about them; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, minhash, quality, toxicity
from tessera.llm.queries import quality_field, toxicity_machine, vocabulary
from tessera.session import cut_lineage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accept(docs, toxicity_machine(docs, _table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accept(docs, quality_field(docs, _table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, width=5, share=(80, 100))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: training, hashing and byte-pair merges are beyond SQL: tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
