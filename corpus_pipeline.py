"""A training corpus from raw documents: stages that each keep, change or pack what the stage before has kept.

Every stage is written as Parquet to the shared folder and read again, so a lost
executor never sets more than one stage back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import decontaminate, packing, quality, secrets, similar
from flowloom.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier doesn't reject."""
    model = quality.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judged(docs.select(*COLUMNS), model).filter("keep").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates that share 0.8 of their five-word shingles.

    SimHash fingerprints that meet by generalised pigeonhole (op4's method) give the first links, verified on the
    shingles; prefix filtering finds the pairs whose fingerprints lie further apart.
    """
    return similar.one_of_each(docs.select(*COLUMNS), size=5, similarity=0.8).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word passage of the benchmark."""
    return decontaminate.decontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets replaced."""
    return secrets.redacted(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 1024 tokens."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("secrets", safe), ("packing", packed),
]

#: The classifier is fitted by gradient steps, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
