"""Token counts through a digest cache: only texts that no one has counted with this tokenizer are encoded."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from eventlens.llm.common import utf8_bytes

CACHE = "text_digest binary, tokenizer_digest binary, n_tokens bigint"
LIMIT = 4096


def load_tokenizer(path: str) -> tuple[bytes, bytes]:
    """The tokenizer file (a few MB, its size does not depend on the data) and its version digest."""
    with open(path, "rb") as file:
        model = file.read()
    kind = b"sentencepiece" if path.endswith(".model") else b"tokenizers"
    return model, hashlib.sha256(kind + b"\0" + model).digest()


def counter(path: str, model: bytes) -> Callable[[list[str]], list[int]]:
    """Counts as the library gives them: no begin or end tokens, no truncation, no padding."""
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(model)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _encode(path: str, model: bytes, version: bytes, batch_bytes: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, model)
        for batch in batches:
            texts, counts, held = [], [], 0
            for text in batch.column(1).to_pylist():
                texts.append(text)
                held += len(text)
                if held > batch_bytes:
                    counts += count(texts)
                    texts, held = [], 0
            counts += count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([version] * len(counts), pa.binary()), pa.array(counts, pa.int64())],
                names=["text_digest", "tokenizer_digest", "n_tokens"],
            )

    return encode


def _cached(spark: SparkSession, cache: str, version: bytes) -> DataFrame:
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException:  # no cache yet
        stored = spark.createDataFrame([], CACHE)
    return stored.where(F.col("tokenizer_digest") == F.lit(version)).select("text_digest", "n_tokens")


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT, batch_bytes: int = 1 << 20) -> DataFrame:
    """Every document with its bytes, its tokens and whether it has more than `limit` tokens.

    `cache` is a folder of parquet files that all executors reach: counts by digest of the content and of the tokenizer.
    The normalised content is the text itself with null as empty: anything coarser could change the count. The distinct
    contents that the cache lacks are encoded once each, appended, and then all counts are read from the cache. If the
    append fails half-way, no file of it is visible; if two writers append the same digest, either row is right and the
    distinct below drops the second.

    Null and empty texts have 0 bytes and the count of the empty text. Copies are encoded once and counted for every
    row; the join on the digest has one cache row per text, so that a text that makes up a third of all rows can be
    split by Spark. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    model, version = load_tokenizer(tokenizer)
    content = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(content, 256))
    texts = docs.select(digest.alias("text_digest"), content.alias("text"))
    known = _cached(spark, cache, version)
    misses = texts.join(known, "text_digest", "left_anti").groupBy("text_digest").agg(F.first("text").alias("text"))
    encoded = misses.mapInArrow(_encode(tokenizer, model, version, batch_bytes), CACHE)
    encoded.write.mode("append").parquet(cache)
    counts = _cached(spark, cache, version).groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = docs.select("doc_id", digest.alias("text_digest"), utf8_bytes(F.col("text")).alias("n_bytes"))
    return rows.join(counts, "text_digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
