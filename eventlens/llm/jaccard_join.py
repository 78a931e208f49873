"""Similarity join of word n-gram sets by T-occurrence search with DivideSkip (Li, Lu and Lu, 2008).

Two sets of sizes x and y whose Jaccard similarity reaches s share at least T = s / (1 + s) * (x + y) shingles. An
inverted list per shingle holds the sets that have it; wanted are the sets on at least T of a set's lists. DivideSkip
merges only the short lists by a heap and looks the rest up in the long ones by binary search.

Across the cluster, a set's short lists are its rarest shingles: T - 1 lists may be left aside, so whoever reaches T is on
one of the others. Spark groups these few lists; what meets there is a candidate. Candidates are then sent, in blocks, to
one of their number, where DivideSkip over the block's whole sets finds who reaches T and by how much.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.components import components
from eventlens.llm.rolling import run_hashes, word_hashes
from eventlens.operators.ordering import checkpointed, discard

SHINGLE, PERCENT = 4, 85
#: Shingles that several sets of a stretch of text share are counted in this many buckets, to put them last in the order.
BUCKET_BITS, STRETCH = 20, 500_000
#: Tokens on several lists are marked in at most so many bits; more tokens are then taken for such, and left out by a count.
MARK_BITS = 27
SKETCH = 8  # numbers of 64 bits in a set's sketch
TRIES = 3  # sets of its lists' main components that a set is compared with before all candidates are
BLOCK = 256  # sets that are searched together
GROUP = 1000  # candidates of one set that one task gets at a time
BROADCAST_NODES = 4_000_000  # ids; above, texts are shuffled instead
NEAR, BETWEEN, FAR = 0, 1, 2


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles, of the whole sequence if it is shorter; A-Z count as a-z."""
    words = word_hashes(text, lower=True)
    return np.unique(run_hashes(words, min(n, len(words)))) if len(words) else np.zeros(0, dtype=np.uint64)


def overlap_needed(x, y, percent: int):
    """Least overlap at which 100 * overlap >= percent * (x + y - overlap)."""
    return -(-percent * (x + y) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Lists that are left when one less than the overlap any similar set needs is put aside."""
    return n - (percent * n + 99) // 100 + 1


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Of each bucket of a set's shingles, whether they are odd in number. Sketches of two sets differ in no more bits than
    there are shingles in only one of them (bitmap filter of Sandes, Teodoro and Melo, 2020)."""
    odd = np.bincount((tokens & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


# --- DivideSkip --------------------------------------------------------------------------------------------------


def merge_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """Members on at least `least` of the sorted lists, with how many. While the smallest member is on too few lists, the
    heap gives up as many lists as cannot help it and skips them ahead by binary search."""
    heads = [(members[0], i, 0) for i, members in enumerate(lists) if members]
    heapq.heapify(heads)
    found = {}
    while len(heads) >= least:
        member, popped = heads[0][0], []
        while heads and heads[0][0] == member:
            popped.append(heapq.heappop(heads))
        if len(popped) >= least:
            found[member] = len(popped)
            target = member + 1
        else:
            while len(popped) < least - 1 and heads:
                popped.append(heapq.heappop(heads))
            if not heads:
                break
            target = max(heads[0][0], member + 1)
        for _, i, at in popped:
            at = bisect_left(lists[i], target, at)
            if at < len(lists[i]):
                heapq.heappush(heads, (lists[i][at], i, at))
    return found


def divide_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """Members on at least `least` lists, with how many: short lists are merged, the longest are only probed."""
    lists = sorted(lists, key=len)
    if len(lists) < least:
        return {}
    longest = max(len(lists[-1]), 2)
    aside = min(least - 1, int(least / (0.0085 * np.log2(longest) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside:]
    found = {}
    for member, count in merge_skip(short, least - aside).items():
        for left, members in enumerate(long):
            if count + aside - left < least:
                break
            at = bisect_left(members, member)
            count += at < len(members) and members[at] == member
        if count >= least:
            found[member] = count
    return found


def search(query: np.ndarray, block: list[np.ndarray], percent: int) -> dict[int, int]:
    """Positions in the block of the sets with Jaccard similarity of at least `percent` to the query; their overlaps."""
    sizes = np.array([len(b) for b in block])
    fit = np.flatnonzero((100 * np.minimum(sizes, len(query)) >= percent * np.maximum(sizes, len(query))))
    if not len(fit):
        return {}
    tokens = np.concatenate([block[i] for i in fit])
    owners = np.repeat(np.arange(len(fit)), sizes[fit])
    at = np.minimum(np.searchsorted(query, tokens), len(query) - 1)
    shared = query[at] == tokens
    order = np.lexsort((owners[shared], at[shared]))
    at, owners = at[shared][order], owners[shared][order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    lists = [part.tolist() for part in np.split(owners, cuts)] if len(at) else []
    least = int(overlap_needed(len(query), sizes[fit].min(), percent))
    found = divide_skip(lists, max(least, 1))
    return {int(fit[i]): n for i, n in found.items()
            if n >= overlap_needed(len(query), int(sizes[fit[i]]), percent)}


# --- tasks -------------------------------------------------------------------------------------------------------


def _count_common(bits: int, shingle: int):
    """In each stretch of text, the sets that share a shingle, added up by bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, n = np.zeros(1 << bits, dtype=np.int64), [], 0

        def add() -> None:
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            common = times > 1
            np.add.at(counts, (tokens[common] >> np.uint64(64 - bits)).astype(np.int64), times[common])

        for batch in batches:
            for text in batch.column(0):  # one at a time: texts may be long
                held.append(shingles(text.as_py(), shingle))
                n += len(held[-1])
                if n >= STRETCH:
                    add()
                    held, n = [], 0
        if held:
            add()
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    return count


def _describe(levels: np.ndarray, bits: int, percent: int, shingle: int):
    """Of each document: size, digest and sketch of its set, and its rarest shingles with their places in the order."""
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                sizes, digests, rare, sketches = [], [], [], []
                for text in part.column(1).to_pylist():
                    tokens = shingles(text, shingle)
                    sizes.append(len(tokens))
                    digests.append(hashlib.md5(tokens.tobytes()).digest())
                    sketches.append(sketch(tokens))
                    level = levels[(tokens >> np.uint64(64 - bits)).astype(np.int64)]
                    order = np.lexsort((tokens, level))[: prefix_length(len(tokens), percent) if len(tokens) else 0]
                    rare.append(tokens[order].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(rare, pa.list_(pa.int64())),
                     pa.array(sketches, pa.list_(pa.int64())), *part.columns[2:]],
                    names=["id", "n", "digest", "rare", "sketch", *part.schema.names[2:]])

    return describe


def _marked(marks: np.ndarray, bits: int):
    """Rows of the lists for those rarest shingles of each class (node, n, rare) whose mark is set."""
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rare = batch.column(2)
            tokens, lengths = rare.flatten().to_numpy(zero_copy_only=False), rare.value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            bucket = tokens.view(np.uint64) >> np.uint64(64 - bits)
            on = np.flatnonzero(marks[bucket >> np.uint64(6)] >> (bucket & np.uint64(63)) & np.uint64(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owner[on]), batch.column(1).take(owner[on]), pa.array(place[on].astype(np.int32)), pa.array(tokens[on])],
                names=["node", "n", "place", "token"])

    return marked


def _sets(shingle: int):
    """Sets of the texts that are a class's own (rows of node, its digest, text), each once per task."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                nodes, tokens = [], []
                for node, digest, text in zip(*(batch.slice(start, 200).column(i).to_pylist() for i in range(3))):
                    if node not in seen:
                        found = shingles(text, shingle).tobytes()
                        if hashlib.md5(found).digest() == digest:  # an id may have other texts too
                            seen.add(node)
                            nodes.append(node)
                            tokens.append(found)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(tokens, pa.binary())], names=["node", "tokens"])

    return sets


def _verify(percent: int, loose: int):
    """Rows come by (asking, part), the asking set first. Gives how near each other one is to it."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, query, nodes, sets = None, None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if nodes:
                overlaps = search(query, sets, loose)
                near = [
                    FAR if i not in overlaps
                    else NEAR if overlaps[i] >= overlap_needed(len(query), len(s), percent) else BETWEEN
                    for i, s in enumerate(sets)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([asking] * len(nodes), pa.int64()), pa.array(nodes, pa.int64()), pa.array(near, pa.int32())],
                    names=["a", "b", "near"])
                nodes.clear()
                sets.clear()

        for batch in batches:
            for a, b, tokens in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if a == b:
                    yield from flush()
                    asking, query = a, np.frombuffer(tokens, dtype=np.uint64)
                    continue
                nodes.append(b)
                sets.append(np.frombuffer(tokens, dtype=np.uint64))
                if len(nodes) >= BLOCK:
                    yield from flush()
        yield from flush()

    return verify


# --- the join ----------------------------------------------------------------------------------------------------


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, loose: int) -> DataFrame:
    """(a, b, near) for candidate pairs (a, b). A set with very many candidates is sent out with a part of them each."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b")
    others = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "tokens")
    asking = parts.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")).join(
        sets.withColumnRenamed("node", "a"), "a").select("a", "part", F.col("a").alias("b"), "tokens")
    rows = asking.union(others).repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("b"))
    return checkpointed(rows.mapInArrow(_verify(percent, loose), "a bigint, b bigint, near int").distinct())


def link_documents(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Every document with the size of its shingle set and its component: the smallest id reachable by links.

    Two documents are linked if 100 * overlap >= percent * union of their sets. Documents without words have an empty set
    and are linked with nothing. A null id has no component (null) and is linked with nothing. Rows that share an id are
    one document with several texts: what any of them reaches, all do. Only doc_id and text are read. An empty table
    gives no rows.

    Documents with equal sets form a class, found by digest, and only one of a class is searched for. Links inside large
    groups of near copies are not all made: in a first round each set is compared with the first one of each of its lists,
    in a second one, if it is outside its lists' main components, with a few of their members. What is linked by then is
    one component already. In the last round, all candidates of different components are compared, but for those that
    the first round rules out: as 1 - similarity is a metric, a set that is near the first one and a set far from it
    cannot be near each other. In no round are sets compared whose sketches show that they differ too much.
    """
    rows, found = _linked(docs.select(F.col("doc_id").cast("bigint").alias("id"), "text"), percent, shingle, by_id=True)
    smallest = found.groupBy("label").agg(F.min("id").alias("component_id"))
    named = checkpointed(found.join(smallest, "label").select("digest", "component_id"))
    discard(found)
    return rows.join(named, "digest", "left").select(
        F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def _linked(texts: DataFrame, percent: int, shingle: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (id, n, digest of the set, more columns of `texts`), and the component (digest, id, label) of each set that a
    row with an id has. With `by_id` the sets of one id are linked, too."""
    spark = texts.sparkSession
    loose = 100 - 2 * (100 - percent)  # further than twice the distance from what others are near to
    common = texts.select("text").mapInArrow(_count_common(BUCKET_BITS, shingle), "bucket bigint, n bigint").groupBy("bucket").agg(
        F.sum("n").alias("n")).toArrow()
    levels = np.zeros(1 << BUCKET_BITS, dtype=np.uint8)
    levels[common.column("bucket").to_numpy()] = np.log2(1 + common.column("n").to_numpy()).astype(np.uint8)
    more = "".join(f", {c} {kind}" for c, kind in texts.dtypes[2:])
    rows = checkpointed(texts.mapInArrow(
        _describe(levels, BUCKET_BITS, percent, shingle), f"id bigint, n bigint, digest binary, rare array<bigint>, sketch array<bigint>{more}"))
    known = rows.where("id is not null and n > 0")
    classes = checkpointed(known.groupBy("digest").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("sketch").alias("sketch")
    ).withColumn("node", F.monotonically_increasing_id()))

    lists = _lists(classes)
    tokens = lists.groupBy("token").agg(F.min(F.struct("node", "n", "place")).alias("first"), F.count("*").alias("sets")).where(
        "sets > 1")
    fit = _may_link(F.col("n"), F.col("place"), F.col("first.n"), F.col("first.place"), percent)
    led = (F.col("first.node") < F.col("node")) & fit
    # A list of two has one pair only; the others come back in the second round.
    shared = checkpointed(lists.alias("l").join(tokens.alias("t"), (F.col("l.token") == F.col("t.token")) & (led | (F.col("sets") > 2))).select(
        "l.*", "first", "sets"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Sets of the nodes that occur in pairs (a, b), from the texts. The ids are broadcast if they are few."""
        wanted = checkpointed(nodes.select(F.col("a").alias("node")).union(nodes.select("b")).distinct().join(
            classes.select("node", "id", "digest"), "node"))
        few = wanted.count() <= BROADCAST_NODES
        own = texts.join(F.broadcast(wanted) if few else wanted, "id").select("node", "digest", "text")
        return checkpointed(own.mapInArrow(_sets(shingle), "node bigint, tokens binary"))

    x, y = (classes.select(F.col("node").alias(c), F.struct("n", "sketch").alias(f"of_{c}")) for c in "ab")
    starts = shared.where(led).select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
    starts = checkpointed(starts.join(x, "a").join(y, "b").where(_sketches_allow("of_a", "of_b", percent)).select("a", "b"))
    sets = sets_of(starts)
    first_round = _verified(starts, sets, percent, loose)
    near = first_round.where(F.col("near") == NEAR).select("a", "b")
    near = checkpointed(near.union(_sharing_ids(rows, classes)) if by_id else near)
    labels = components(classes.select("node"), near)
    members = _members(shared, labels, first_round, classes)
    discard(starts, sets, shared, first_round, labels)
    pairs = _tries(members, percent)
    sets = sets_of(pairs)
    second_round = _verified(pairs, sets, percent, loose)
    nearer = checkpointed(near.union(second_round.where(F.col("near") == NEAR).select("a", "b")))
    labels = components(classes.select("node"), nearer)
    discard(pairs, sets, second_round, near)
    pairs = _remaining(members, labels, percent)
    discard(members, labels)
    sets = sets_of(pairs)
    last_round = _verified(pairs, sets, percent, loose)
    labels = components(classes.select("node"), nearer.union(last_round.where(F.col("near") == NEAR).select("a", "b")))
    discard(pairs, sets, last_round, nearer)

    found = checkpointed(classes.join(labels, "node").select("digest", "id", "label"))
    discard(labels, classes)
    return rows, found


def one_of_each(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.

    Documents that are linked with nothing all stay, so do those without words and those with null ids. Each text of an id
    is judged on its own: different texts that share an id stay unless they are linked. Of the smallest id's texts in a
    component, and of rows with equal id and text, one stays. Other columns may have any names.
    """
    name = lambda c: "_" * (1 + max(map(len, docs.columns))) + c  # noqa: E731  like no column of docs
    key = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    rows, found = _linked(docs.select(F.col("doc_id").cast("bigint").alias("id"), "text", key.alias("key")), percent, shingle, by_id=False)
    known = rows.where("id is not null and n > 0").join(found.select("digest", "label"), "digest")
    first = known.groupBy("label").agg(F.min(F.struct("id", "key")).alias("first")).select("first.*")
    wordless = rows.where("id is not null and n = 0").select("id", "key").distinct()
    stays = checkpointed(first.union(wordless).distinct().select(
        F.col("id").cast(docs.schema["doc_id"].dataType).alias(name("id")), F.col("key").alias(name("key")), F.lit(True).alias(name("one"))))
    discard(rows, found)
    marked = docs.withColumn(name("own"), key)
    kept = marked.join(stays, (marked["doc_id"] == stays[name("id")]) & (marked[name("own")] == stays[name("key")]))
    # a third of all rows may be one; rows without words all stay
    once = Window.partitionBy("doc_id", name("own")).orderBy(F.lit(1))
    numbered = kept.withColumn(name("place"), F.row_number().over(once)).where(F.col(name("place")) == 1)
    return numbered.select(*docs.columns).union(docs.where(F.col("doc_id").isNull()))


def _sharing_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id, as pairs with the first of them."""
    repeated = rows.where("id is not null and n > 0").select("id", "digest").distinct().groupBy("id").agg(
        F.count("*").alias("_texts")).where("_texts > 1").select("id")
    of = rows.join(repeated, "id", "left_semi").select(F.col("id").alias("_id"), "digest").distinct().join(
        classes.select("digest", "node"), "digest")
    first = of.groupBy("_id").agg(F.min("node").alias("a"))
    return of.join(first, "_id").where("node > a").select("a", F.col("node").alias("b"))


def _lists(classes: DataFrame) -> DataFrame:
    """(node, n, place, token) for the rarest shingles of each class that another one may have among its own."""
    several = checkpointed(classes.select(F.explode("rare").alias("token")).groupBy("token").agg(F.count("*").alias("sets")).where(
        "sets > 1").select("token"))
    bits = min(MARK_BITS, max(10, (16 * several.count()).bit_length()))
    marks = np.zeros(1 << bits - 6, dtype=np.uint64)
    bucket = several.select(F.shiftrightunsigned("token", 64 - bits).alias("bucket"))
    words = bucket.groupBy(F.shiftright("bucket", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bucket & 63 as int)))").alias("marks")).toArrow()
    marks[words.column("word").to_numpy()] = words.column("marks").to_numpy().view(np.uint64)
    discard(several)
    return classes.select("node", "n", "rare").mapInArrow(_marked(marks, bits), "node bigint, n bigint, place int, token bigint")


def _members(shared: DataFrame, labels: DataFrame, first_round: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of the lists that hold several components, each with its sketch and with how near a first one it is."""
    compared = first_round.groupBy(F.col("b").alias("node")).agg(F.min(F.struct(F.col("a").alias("lead"), "near")).alias("c")).select(
        "node", "c.*")
    members = _of_mixed_lists(shared.where("sets > 2").select("token", "node", "n", "place"), labels)
    return checkpointed(members.join(compared, "node", "left").join(classes.select("node", "sketch"), "node").select(
        "token", "node", "n", "place", "sketch", "label", "main", F.coalesce("lead", "node").alias("lead"),
        F.coalesce("near", F.lit(NEAR)).alias("near")))


def _of_mixed_lists(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of lists with several components, with their component and the list's main one."""
    labelled = members.join(labels, "node")
    mixed = labelled.groupBy("token").agg(F.min("label").alias("main"), F.max("label").alias("_last")).where(
        "main <> _last").select("token", "main")
    return labelled.join(mixed, "token")


def _tries(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a set outside a list's main component with sets inside. Each list proposes two, other lists other
    ones, and those with the likest sketches are taken."""
    one, by = F.struct("node", "n", "place", "sketch"), F.xxhash64("node", "token")
    inside = members.where("label = main").groupBy("token").agg(F.array(F.min_by(one, by), F.max_by(one, by)).alias("inside"))
    x = members.where("label <> main").join(inside, "token").withColumn("y", F.explode("inside")).withColumn("x", one)
    c = F.col
    fit = _may_link(c("x.n"), c("x.place"), c("y.n"), c("y.place"), percent) & _sketches_allow("x", "y", percent)
    likest = Window.partitionBy("x").orderBy("differ", "y")  # a row for each list of x at most
    tries = x.where(fit).select(c("x.node").alias("x"), c("y.node").alias("y"), _differing("x", "y").alias("differ")).distinct()
    return checkpointed(tries.withColumn("rank", F.row_number().over(likest)).where(c("rank") <= TRIES).select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def _remaining(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs that the rounds before leave open: on one list, in different components, of fitting sizes."""
    members = checkpointed(_of_mixed_lists(members.drop("label", "main"), labels))
    # A list's main component is not paired with itself: only its other members are looked at from the left.
    x, y = members.where("label <> main").alias("x"), members.alias("y")
    c = F.col
    once = (c("y.label") == c("y.main")) | (c("x.node") < c("y.node"))
    fit = _may_link(c("x.n"), c("x.place"), c("y.n"), c("y.place"), percent) & _sketches_allow("x", "y", percent)
    apart = (c("x.lead") == c("y.lead")) & (
        ((c("x.near") == NEAR) & (c("y.near") == FAR)) | ((c("x.near") == FAR) & (c("y.near") == NEAR))
        | (c("x.node") == c("y.lead")) | (c("y.node") == c("x.lead")))
    pairs = x.join(y, (c("x.token") == c("y.token")) & (c("x.label") != c("y.label")) & once & fit & ~apart)
    found = checkpointed(pairs.select(
        F.least(c("x.node"), c("y.node")).alias("a"), F.greatest(c("x.node"), c("y.node")).alias("b")).distinct())
    discard(members)
    return found


def _differing(x: str, y: str) -> Column:
    """Bits in which the sketches of two rows differ."""
    bits = [F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(SKETCH)]
    return sum(bits[1:], bits[0])


def _sketches_allow(x: str, y: str, percent: int) -> Column:
    """Can the sets of two rows be linked? Twice their overlap is at most their sizes less the bits that differ."""
    sizes = F.col(f"{x}.n") + F.col(f"{y}.n")
    return (100 + percent) * (sizes - _differing(x, y)) >= 2 * percent * sizes


def _may_link(n: Column, place: Column, m: Column, at: Column, percent: int) -> Column:
    """Can two sets of n and m shingles be linked if this shared one has these places in their orders? Shared shingles
    are in the same order in both; if this is their first, only those after it can be shared as well. A linked pair has
    a first one, so that it is found there."""
    sizes = (100 * n >= percent * m) & (100 * m >= percent * n)
    return sizes & ((100 + percent) * F.least(n - place, m - at) >= percent * (n + m))
