"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, documents
that leak benchmark items go, personal data is masked, and the rest is encoded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import byte_bpe, decontaminate, near_duplicates, personal_data, toxicity
from weft.llm.common import forget, shared_dir, table
from weft.llm.queries import split_pattern, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(model, docs["text"]) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal_data.mask(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(docs, tokenizer_file(), split_pattern(), keep=("doc_id", "lang", "source")).withColumn("n_tokens", F.size("ids").cast("long")).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal_data),
    ("byte_bpe", encode),
]

#: The stages learn models and match similar texts, which SQL cannot express; tests/llm/test_pipeline.py holds each against a plain loop.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/weft-pipeline-{uuid.uuid4().hex}"
    done: list[str] = []
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        forget(spark, *done)  # nothing reads the stage before any more
        done = [f"{base}/{name}"]
    return docs
