"""The registered queries of this package: one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.llm import (
    bbit,
    bm25,
    language,
    maxscore,
    mixing,
    neighbours,
    packing,
    phrases,
    repair,
    secrets,
    simhash,
    suffixes,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.measured(documents(spark, sf_dir))
    own = [F.col(f"__{c}").alias(c) for c in ("weight", "probability", "sampled")]
    return mixing.mix(rows, topic_col="topic", tokens_col="n_tokens").select(*rows.columns, *own)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.scan(docs, secrets.train(secrets.labelled(docs)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, labels(spark, sf_dir)))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id % 20 = 0")
    return bm25.search(bm25.build_index(documents(spark, sf_dir)), asked)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.predict(docs, language.train(docs))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_phrase_automata_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_passages(documents(spark, sf_dir))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair.repair(repair.damage(turns), turns)


def op12_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit.near_duplicates(documents(spark, sf_dir))


def op13_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return maxscore.search(maxscore.build_index(documents(spark, sf_dir)), items)


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_secret_scan": op2_secret_scan,
    "op3_toxicity": op3_toxicity,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_language_id": op5_language_id,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_phrase_automata_dedup": op8_phrase_automata_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_bbit_minhash": op12_bbit_minhash,
    "op13_maxscore_search": op13_maxscore_search,
}

ORACLES: dict[str, str] = {"op4_exact_top_k": bm25.SQL, "op12_bbit_minhash": bbit.SQL, "op13_maxscore_search": maxscore.SQL}
