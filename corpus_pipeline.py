"""Corpus preparation as stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopyframe.llm import byte_bpe, ngram_join, pareto_mix, pii, quality
from canopyframe.llm.common import table
from canopyframe.runtime import ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps."""
    return quality.apply_policy(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by five-word shingles at 0.8 or more.

    Documents without words link with nothing and stay. Of repeated rows one stays.
    Rows without an id give way to any linked one that has an id; of a group without
    ids one row stays. Rows that agree in id and text but not in other columns are
    repeated rows; the same one of them stays in each run.
    """
    groups = ngram_join.keyed_components(ngram_join.keyed(docs), words=5, percent=80)
    nameless = groups.where(F.col("component_id").isNull() & F.col("root").isNotNull())
    first = nameless.groupBy("root").agg(F.min("key").alias("first"))
    others = nameless.join(first, "root").where(F.col("key") != F.col("first")).select("key")
    late = groups.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("key")
    gone = late.unionByName(others).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                         ngram_join.row_key(F.col("doc_id"), F.col("text")).alias("key"), F.xxhash64(F.lit("second"), "doc_id", "text").alias("second"))
    rows = packed.join(gone, "key", "left_anti")
    place = F.row_number().over(Window.partitionBy("key", "second").orderBy(F.xxhash64("doc")))
    return rows.withColumn("place", place).where(F.col("place") == 1).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in place of personal data."""
    return pii.pseudonymise(docs, "canopyframe").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture at the target weights; a document that it takes twice is there twice."""
    return pareto_mix.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document: ``doc_id, lang, source, n_tokens, ids``."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: SQL has no byte-level BPE; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
