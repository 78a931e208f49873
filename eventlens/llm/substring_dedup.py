"""Exact substring deduplication by seed and extend.

Seeds are winnowed anchors (Schleimer et al., 2003): of every 20 consecutive words, the run of six words with the least
hash. Equal windows choose the same anchor at the same place, so that only windows around anchors that occur more than
once can repeat. From these seeds the match is extended to both sides: all windows that chose the seed are compared by
their content, and the union of the repeated ones are the maximal repeats of at least 20 words.

Occurrences are never paired. A window is a repeat if it is not the first of its content; ranking by content finds all
of them, however many documents share a passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import split_words, words
from eventlens.llm.rolling import run_hashes, word_hashes
from eventlens.operators.ordering import checkpointed

WINDOW, SEED_WORDS = 20, 6
#: Anchors seen at least so often are joined by broadcast, so that no task gets all their occurrences. At most HOT of
#: them, the most frequent: every other anchor then has less than one occurrence in HOT of all.
HOT_COUNT, HOT = 1000, 10_000
#: Occurrences of a window are ranked in groups of about so many, and then the first ones of the groups.
GROUP = 2000
LAST = (1 << 63) - 1  # null ids come last
#: Bits of the hash by which texts are dealt out. Texts that share it are told apart by a count in the bits below it: both
#: together are a text's number, which goes into every narrow row.
KEY_BITS, TWIN_BITS = 40, 23


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of words its anchor's position, and the hashes of all runs of SEED_WORDS words."""
    runs = run_hashes(words, SEED_WORDS)
    span = window - SEED_WORDS + 1
    if len(runs) < span:
        return np.zeros(0, dtype=np.int64), runs
    least = np.lib.stride_tricks.sliding_window_view(runs, span).argmin(axis=1)
    return least + np.arange(len(least)), runs


def _first_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once per task: copies are left out before texts are shuffled."""
    seen = set()
    for batch in batches:
        new = []
        for i, digest in enumerate(batch.column(1).to_pylist()):
            if digest not in seen:
                seen.add(digest)
                new.append(i)
        yield batch.take(pa.array(new, pa.int64()))


def _emit_anchors(window: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                hashes, numbers, places = [], [], []
                part = batch.slice(start, 500)
                for number, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    chosen, runs = anchors(word_hashes(text), window)
                    chosen = np.unique(chosen)
                    hashes.append(runs[chosen].view(np.int64))
                    places.append(chosen.astype(np.int32))
                    numbers.append(np.full(len(chosen), number))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hashes)), pa.array(np.concatenate(numbers)), pa.array(np.concatenate(places))],
                    names=["anchor", "number", "place"])

    return emit


def _emit_windows(window: int):
    """Windows whose anchor is repeated, with 96 bits of hashes of their content. Places may be those of texts with the same key
    too; only the text's own count."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, first, text, places = (batch.column(i)[row] for i in range(4))
                words = word_hashes(text.as_py())
                chosen, _ = anchors(words, window)
                groups = np.zeros(len(words) + 1, dtype=np.int32)
                twin, at, into = (places.values.field(c).to_numpy(zero_copy_only=False) for c in ("twin", "place", "groups"))
                own = twin == number.as_py() % (1 << TWIN_BITS)
                groups[at[own]] = into[own]
                starts = np.flatnonzero(groups[chosen])
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(run_hashes(words, window)[starts].view(np.int64)),
                     pa.array((run_hashes(words, window, 1)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                     pa.array(groups[chosen[starts]]), pa.array(np.full(n, first.as_py())),
                     pa.array(np.full(n, number.as_py())), pa.array(starts.astype(np.int32))],
                    names=["w1", "w2", "groups", "first", "number", "start"])

    return emit


def _remove(window: int, keep_text: bool):
    """What is left of each text (third from the end: text, starts of its repeated windows, whether it was null) when the
    words of these windows are taken out. The columns before are passed on."""
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = batch.num_columns - 3
            n_words, n_removed, texts, digests = [], [], [], []
            for text, starts, was_null in zip(batch.column(passed).to_pylist(), batch.column(passed + 1), batch.column(passed + 2).to_pylist()):
                words = split_words(text)
                n_words.append(len(words))
                if starts.is_valid and len(starts):
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    at = starts.values.to_numpy(zero_copy_only=False)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                    gone = np.cumsum(gone[:-1]) > 0
                    n_removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone) if not g]
                else:
                    n_removed.append(0)
                left = " ".join(words)
                digests.append(hashlib.sha256(left.encode("utf-8", "replace")).hexdigest())
                texts.append((left if n_removed[-1] else None if was_null else text) if keep_text else None)  # else as it was
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:passed], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests),
                 pa.array(texts, pa.string())],
                names=[*batch.schema.names[:passed], "n_words", "n_removed", "kept_sha256", "kept_text"])

    return remove


def _equal(a: Column, b: Column) -> Column:
    """Equality that Spark does not take for a join key: the join then keeps to the partitions by `key`."""
    return (a >= b) & (a <= b)


def _key_of(number: str) -> Column:
    return F.shiftright(number, TWIN_BITS)


def _repeated_windows(texts: DataFrame, firsts: DataFrame, window: int) -> DataFrame:
    """Windows (first, number, start) whose content starts earlier as well, out of distinct texts by `key`."""
    found = texts.select("number", "text").mapInArrow(_emit_anchors(window), "anchor bigint, number bigint, place int")
    found = found.where("anchor is not null")  # as joins add it: all uses then share one shuffle; so for `groups` below
    counted = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    frequent = F.broadcast(counted.where(F.col("n") >= HOT_COUNT).orderBy(F.desc("n"), "anchor").limit(HOT).withColumnRenamed("n", "hot"))
    # Texts are taken apart once for both joins: where the first one gave the count, the second has a key that spreads rows.
    sought = F.when(F.col("hot").isNull(), F.col("anchor")).otherwise(F.xxhash64("number", "place"))
    repeated = found.join(frequent, "anchor", "left").withColumn("anchor", sought).join(counted, "anchor", "left").withColumn(
        "n", F.coalesce("hot", "n")).where("n is not null")
    seeds = repeated.groupBy(_key_of("number").alias("key")).agg(F.collect_list(F.struct(
        (F.col("number") % (1 << TWIN_BITS)).cast("int").alias("twin"), "place",
        F.ceil(F.col("n") / GROUP).cast("int").alias("groups"))).alias("places"))  # as many as the texts of a key have
    seeded = _with_first(texts, firsts).join(seeds.hint("merge"), "key").select("number", "first", "text", "places")
    windows = seeded.mapInArrow(
        _emit_windows(window), "w1 bigint, w2 int, groups int, first bigint, number bigint, start int"
    ).where("groups is not null").withColumn("member", F.pmod(_key_of("number"), "groups"))
    order = ["first", "number", "start"]

    def later(by: list[str]) -> Column:  # not the first of its group
        return F.lag("start").over(Window.partitionBy(*by).orderBy(*order)).isNotNull()

    # All windows of one content have the same `groups`; as part of the keys both uses below share one shuffle.
    ranked = windows.withColumn("later", later(["w1", "w2", "groups", "member"]))
    # One product: a condition on `groups` alone would be moved ahead of the shuffle, which then were two.
    leading = ranked.where((~F.col("later")).cast("int") * F.col("groups") > 1).withColumn("later", later(["w1", "w2"]))
    return ranked.where("later").select(*order).unionByName(leading.where("later").select(*order))


def _with_first(texts: DataFrame, firsts: DataFrame) -> DataFrame:
    f = firsts.withColumnRenamed("digest", "_digest")
    return texts.join(f.hint("merge"), "key").where(_equal(F.col("digest"), F.col("_digest"))).drop("_digest")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Every document with its words, those removed, and the SHA-256 of what is left.

    Removed is each word covered by a run of `window` words that also starts earlier: in a document with a smaller id, or
    before in the same one. Runs are judged on the input. Words are taken as they are. Null and blank texts have none.
    Null ids come last; documents with equal ids come in the order of hashes of their text; rows equal in both are one
    document and get one result. With `keep`, a list of columns of `docs`, these and `kept_text` are returned too (null
    texts stay null). An empty table gives no rows. Other columns are not read.

    Copies of a text are set aside first: all their words start earlier in the first copy. The texts are shuffled once,
    by a hash; Spark uses that shuffle again wherever the texts are needed. What else moves are narrow rows.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep = keep or []
    content = F.coalesce(F.col("text"), F.lit(""))
    key = F.pmod(F.xxhash64(content), F.lit(1 << KEY_BITS))
    keyed = docs.select(
        key.alias("key"), F.unhex(F.md5(content)).alias("digest"), content.alias("text"))
    # All but the text; of texts too short for a window, that too.
    found = docs.select(
        F.col("doc_id").alias("_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("_order"),
        key.alias("key"), F.unhex(F.md5(content)).alias("digest"), F.col("text").isNull().alias("_null"),
        F.struct(*keep).alias("_kept") if keep else F.lit(None).cast("int").alias("_kept"),
        F.col("text").alias("_text"), words(F.col("text")).alias("_words"))
    short = F.size("_words") < window
    rows = checkpointed(found.select(
        "_id", "_order", "key", "digest", "_null", "_kept", F.size("_words").cast("bigint").alias("n_words"),
        F.when(short, F.sha2(F.array_join("_words", " "), 256)).alias("_sha"),
        (F.when(short, F.col("_text")) if keep else F.lit(None).cast("string")).alias("_short")))
    firsts = rows.groupBy("key", "digest").agg(F.min("_order").alias("first"))
    # Every use of the texts asks for the same columns and rows, so that Spark shuffles them once: joins would add the
    # filter by themselves, but not the use that has no join. For the same reason the joins below are all of one kind.
    once = keyed.mapInArrow(_first_in_task, keyed.schema).where("key is not null and digest is not null")
    texts = once.repartition(n, "key").groupBy("key", "digest").agg(F.first("text").alias("text"))
    twin = F.row_number().over(Window.partitionBy("key").orderBy("digest")) - 1  # in the order the groups come in
    texts = texts.withColumn("number", F.shiftleft("key", TWIN_BITS) + twin)
    repeats = _repeated_windows(texts, firsts, window).groupBy("number").agg(
        F.collect_list("start").alias("starts")).select(
        _key_of("number").alias("key"), F.col("number").alias("_number"), "starts")
    placed = rows.join(firsts, ["key", "digest"])
    # The first copy of a text is cut; all of any other starts earlier.
    left = texts.alias("t").join(repeats.alias("r"), (F.col("t.key") == F.col("r.key")) & _equal(F.col("t.number"), F.col("_number")), "left")
    leading = placed.where("_order = first").select(
        F.col("key").alias("_key"), F.col("digest").alias("_digest"), "_id", "_kept", "_null")
    cut = left.join(leading, (F.col("t.key") == F.col("_key")) & _equal(F.col("t.digest"), F.col("_digest"))).select(
        "_id", "_kept", "text", "starts", "_null")
    added = T.StructType.fromDDL("n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    done = cut.mapInArrow(_remove(window, bool(keep)), T.StructType([*cut.schema.fields[:2], *added.fields]))
    copies = placed.where("_order <> first").select(
        "_id", "_kept", "n_words", F.when(F.col("n_words") >= window, F.col("n_words")).otherwise(F.lit(0)).alias("n_removed"),
        F.coalesce("_sha", F.sha2(F.lit(""), 256)).alias("kept_sha256"),
        F.when(F.col("n_words") < window, F.col("_short")).otherwise(F.lit("")).alias("kept_text"))
    return done.unionByName(copies).select(
        F.col("_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256", *(["kept_text", "_kept"] if keep else []))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with the words that stay, columns as they are; n_chars, if there, is that of the new text. Texts
    without repeats keep their white space too. Documents of which nothing stays are left out."""
    others = [c for c in docs.columns if c not in ("text", "doc_id")]
    rest = [c for c in others if c != "n_chars"]
    found = dedup_substrings(docs, window, keep=[*rest, "doc_id"])
    left = found.where("n_removed < n_words or n_words = 0")
    values = {"doc_id": F.col("_kept.doc_id"), "text": F.col("kept_text"), "n_chars": F.char_length("kept_text")}
    return left.select(*[
        values.get(c, F.col(f"_kept.{c}") if c in rest else None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
