"""The training-data operators as queries over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm import (
    jaccard_join, mixing, nearest_vectors, oracles, packing, periodic_runs, quality_classifier, quality_rules, secrets, sharding,
    substring_dedup, token_counts, toxicity, whitening,
)
from eventlens.llm.common import read_table
from eventlens.operators.ordering import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: The others learn models, use tokenizers or pseudorandom permutations, are approximate, or need CRC-32, which DuckDB
#: lacks: they are tested against brute force.
ORACLES: dict[str, str] = {
    "op8_substring_dedup": oracles.substring_dedup(), "op9_jaccard_join": oracles.jaccard_join(), "op11_secret_scan": oracles.secret_scan(),
}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op2_sharding(spark, sf_dir):
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), shards=8)


@query
def op3_token_counts(spark, sf_dir):
    """Starts from a cache of its own, so that every run counts every text."""
    cache = f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), cache)


@query
def op4_quality_rules(spark, sf_dir):
    return quality_rules.rule_quality(read_table(spark, sf_dir, "documents")).drop("votes", "quality_probability")


@query
def op1_quality_classifier(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality_classifier.score_quality(docs, labels)


@query
def op10_toxicity(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, labels)


@query
def op5_packing(spark, sf_dir):
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        model = file.read()
    pieces = packing.pack_documents(read_table(spark, sf_dir, "documents"), model, split_at_spaces=True)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op7_mixing(spark, sf_dir):
    return mixing.mix_documents(read_table(spark, sf_dir, "documents")).drop("source")


@query
def op6_nearest_vectors(spark, sf_dir):
    return nearest_vectors.nearest(read_table(spark, sf_dir, "embeddings"))


@query
def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup_substrings(read_table(spark, sf_dir, "documents"))


@query
def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.link_documents(read_table(spark, sf_dir, "documents"))


@query
def op11_secret_scan(spark, sf_dir):
    spans, counted = secrets.find_secrets(read_table(spark, sf_dir, "documents")), secrets.KINDS[:3]
    return spans.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in counted],
        F.sha2(secrets.span_list(*counted), 256).alias("base_sha256"), secrets.span_list(*secrets.KINDS).alias("spans"))


@query
def op12_whitening(spark, sf_dir):
    return whitening.whiten(read_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("bigint"))


@query
def op13_periodic_runs(spark, sf_dir):
    runs = periodic_runs.periodic_runs(periodic_runs.with_periodic_ends(read_table(spark, sf_dir, "documents")))
    listed = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    return runs.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", listed), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
