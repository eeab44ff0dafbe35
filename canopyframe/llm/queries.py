"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from canopyframe.llm import bag_search, byte_bpe, chat, fm_index, kd_shards, ngram_join, oracles, pareto_mix, pii, pivot_index, quality, spelling, suffix_dedup, url_filter
from canopyframe.llm.common import table


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.op2_byte_bpe(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": lambda spark, d: suffix_dedup.op1_suffix_dedup(table(spark, d, "documents")),
    "op2_byte_bpe": op2,
    "op3_ngram_jaccard": lambda spark, d: ngram_join.op3_ngram_jaccard(table(spark, d, "documents")),
    "op4_chat_format": lambda spark, d: chat.op4_chat_format(table(spark, d, "conversations")),
    "op5_feistel_pii": lambda spark, d: pii.op5_feistel_pii(table(spark, d, "documents")),
    "op6_quality_rules": lambda spark, d: quality.op6_quality(table(spark, d, "documents")),
    "op7_url_filter": lambda spark, d: url_filter.op7_url_filter(table(spark, d, "pages")),
    "op8_pivot_index": lambda spark, d: pivot_index.op8_pivot_index(table(spark, d, "embeddings")),
    "op9_kd_shards": lambda spark, d: kd_shards.op9_kd_shards(table(spark, d, "documents")),
    "pipeline": corpus_pipeline.run,
    "op10_pareto_mix": lambda spark, d: pareto_mix.mixed_sizes(table(spark, d, "documents"), odds=pareto_mix.by_length),
    "op11_fm_decontamination": lambda spark, d: fm_index.op11_fm_decontamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op12_spelling_variants": lambda spark, d: spelling.op12_spelling_variants(table(spark, d, "documents")),
    "op13_bag_search": lambda spark, d: bag_search.op13_bag_search(table(spark, d, "documents"), table(spark, d, "benchmark")),
}

ORACLES: dict[str, str] = {
    "op6_quality_rules": oracles.quality_sql(quality.BASE.hard, quality.DEFAULT.hard, quality.DEFAULT.soft, quality.DEFAULT.votes),
    "op11_fm_decontamination": oracles.DECONTAMINATION,
    "op13_bag_search": oracles.RANKED_SEARCH,
}
