"""The queries of this package, ``op<N>_<name>``, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from doclake.llm import (
    decontaminate,
    filter_audit,
    fim,
    licences,
    main_text,
    neardup,
    neighbours,
    packing,
    quality,
    substrings,
    surrogates,
    token_counts,
    toxicity,
)
from doclake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(oracle: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return add


@query()
def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf, "documents"), VOCABULARY))


@query(decontaminate.oracle())
def op2_benchmark_passages(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start")


@query()
def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf, "labels")))


@query()
def op4_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"))


@query()
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf, "labels")))


@query()
def op6_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf, "documents")).select("doc_id", "text", "n_chars")


@query(licences.oracle())
def op7_licences(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf, "documents"))


@query()
def op8_nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query()
def op9_repeated_windows(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf, "documents"))


@query()
def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents"), VOCABULARY)


@query(main_text.oracle())
def op11_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return main_text.extract(table(spark, sf, "pages"))


@query(fim.oracle())
def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    return fim.digests(table(spark, sf, "documents"))


@query(filter_audit.oracle())
def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))
