"""Sharding and token counts."""

import zlib
from collections import defaultdict

import public_tokenizers
import pytest

from eventlens.llm import sharding, token_counts
from tests.llm.conftest import tuples

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def jump(key, shards):
    at, following = -1, 0
    while following < shards:
        at = following
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        following = int((at + 1) * (2.0**31 / ((key >> 33) + 1)))
    return at


@pytest.mark.parametrize("shards", [1, 2, 8, 9, 70, 1000])
def test_jump_shard(spark, shards):
    keys = [0, 1, -1, 7, 2**63 - 1, -(2**63), 123456789012345, *range(100, 160)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k bigint")
    got = {r.k: r.s for r in df.select("k", sharding.jump_shard(df.k, shards).alias("s")).collect()}
    assert got == {k: jump((k or 0) % 2**64, shards) for k in [*keys, None]}


def test_shard_documents(docs, rows, clashing, empty):
    got = sharding.shard_documents(docs).collect()
    expected = sorted(
        ((d is not None, d or 0), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jump(d or 0, 8), jump(d or 0, 9))
        for d, t, *_ in rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == expected
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(clashing).count() == len(rows)
    assert sharding.shard_documents(empty).count() == 0


@pytest.mark.parametrize("tokenizer", [MODEL, WORDS])
def test_token_counts(docs, rows, clashing, empty, tokenizer, tmp_path):
    cache = f"file://{tmp_path}/cache"
    count = token_counts.counter(tokenizer, token_counts.load_tokenizer(tokenizer)[0])
    expected = sorted(((d is not None, d or 0), len((t or "").encode()), count([t or ""])[0]) for d, t, *_ in rows)
    for df in (docs, clashing):
        got = token_counts.count_tokens(df, tokenizer, cache).collect()
        assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_bytes, r.n_tokens) for r in got) == expected
        assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and any(r.over_limit for r in got)
    stored = docs.sparkSession.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t, *_ in rows})  # each text was encoded once, the second time none
    assert token_counts.count_tokens(empty, tokenizer, cache).count() == 0


def test_token_cache_is_used(spark, tmp_path):
    cache, model = f"file://{tmp_path}/cache", token_counts.load_tokenizer(MODEL)
    import hashlib

    known = [(hashlib.sha256(b"known").digest(), model[1], 77), (hashlib.sha256(b"other").digest(), b"another tokenizer", 5)]
    spark.createDataFrame(known, token_counts.CACHE).write.parquet(cache)
    df = spark.createDataFrame([(1, "known"), (2, "other")], "doc_id bigint, text string")
    got = dict((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(df, MODEL, cache).collect())
    assert got[1] == 77 and got[2] == token_counts.counter(MODEL, model[0])(["other"])[0]
    assert tuples(spark.read.parquet(cache).groupBy("tokenizer_digest").count().select("count")) == [(1,), (2,)]
