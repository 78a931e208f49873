"""Packing, mixing, substring dedup, Jaccard join and the pipeline, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import corpus_pipeline
from eventlens.llm import jaccard_join, mixing, packing, substring_dedup
from eventlens.llm.components import components
from tests.llm.conftest import SCHEMA, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def model():
    with open(TOKENIZER, "rb") as file:
        return file.read()


# --- packing -----------------------------------------------------------------------------------------------------


def test_encoder_gives_the_library_ids(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    texts = [t for _, t, *_ in rows if t] + [
        "a<|endoftext|>b <|startoftext|> c", "İSTANBUL ΟΔΟΣ é ́x", "a b c\x1cd", "don't we'll 'tis 12345 !?…", "<b>x</b>"]
    encode = packing.Encoder(model(), True)
    for _ in range(2):
        got = [np.frombuffer(x, dtype=encode.kind).tolist() for x in encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_balance():
    rng = random.Random(0)
    for _ in range(50):
        sizes = [rng.randrange(1, 100) for _ in range(rng.randrange(1, 60))]
        pieces = packing.balance(sizes, 100, 1.0, 0.01)
        filled, of = Counter(), defaultdict(list)
        for item, start, n, sequence in pieces:
            filled[sequence] += n
            of[item].append((start, n))
        assert max(filled.values()) <= 100 and len(filled) == -(-sum(sizes) // 100)
        for i, size in enumerate(sizes):
            at = 0
            for start, n in sorted(of[i]):
                assert start == at
                at += n
            assert at == size
    # uncut items go, largest first, to the sequence that costs least
    assert packing.balance([60, 50, 40, 30], 100, 1.0, 0.0) == [(0, 0, 60, 0), (1, 0, 50, 1), (2, 0, 40, 1), (3, 0, 30, 0)]


def test_pack_documents(docs, rows, clashing, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    expected = Counter()
    for d, t, *_ in rows:
        expected[(d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes())] += 1
    for df in (docs, clashing):
        sequences, total = defaultdict(list), 0
        by_doc = defaultdict(list)
        for r in packing.pack_documents(df, model(), split_at_spaces=True).collect():
            assert len(r.ids) == 4 * r.length
            sequences[r.sequence_id].append((r.offset, r.length))
            by_doc[r.doc_id].append((r.doc_tokens, r.start, bytes(r.ids)))
            total += r.length
        for pieces in sequences.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= 2048
        assert len(sequences) == -(-total // 2048)  # one group here: no more sequences than needed
        assert total == sum(len(ids) // 4 * n for (_, ids), n in expected.items())
        for (d, ids), n in expected.items():
            whole = [p for p in by_doc[d] if p[0] == len(ids) // 4 and ids[4 * p[1]: 4 * p[1] + len(p[2])] == p[2]]
            assert sum(len(p[2]) for p in whole) >= n * len(ids)
    assert packing.pack_documents(empty, model()).count() == 0


# --- mixing ------------------------------------------------------------------------------------------------------


def test_targets():
    got = mixing.targets({"b": 100, "a": 10, None: 50, "c": 1000})
    assert got["a"] == 30 and sum(got.values()) == pytest.approx(1160)  # a and null are full at three times their size
    assert got[None] == 150 and got["b"] == 300 and got["c"] == pytest.approx(680)
    assert mixing.targets({"a": 0, "b": 7}) == {"a": 0, "b": 7} and mixing.targets({}) == {}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permuted(n):
    assert sorted(mixing.permuted(np.arange(n), n, 99).tolist()) == list(range(n))


def test_draw_shards():
    slots = [1000, 0, 3, 250]
    drawn = list(mixing.draw_shards(slots, 100))
    assert np.sum([c for _, c in drawn], axis=0).tolist() == slots
    assert all(c.sum() == 100 for _, c in drawn[:-1]) and [s for s, _ in drawn] == list(range(len(drawn)))
    first = [c[0] for _, c in drawn[:-1]]
    assert max(first) > min(first)  # drawn, not dealt out evenly


def test_mix_documents(spark, docs, rows, clashing, empty):
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets = mixing.targets(sizes)
    results = []
    for df in (docs, clashing, spark.createDataFrame(rows, SCHEMA).repartition(2)):
        got = mixing.mix_documents(df).collect()
        assert len(got) == len(rows)
        taken = Counter()
        for r in got:
            assert r.taken <= 3 * r["size"] and r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
            taken[r.source] += r.taken
        for s, n in taken.items():
            assert abs(n - targets[s]) <= 2 * mixing.BLOCK_WORDS
        results.append(sorted(map(repr, got)))
    assert results[0] == results[1] == results[2]  # whatever the partitions
    assert mixing.mix_documents(empty).count() == 0


def replayed(rows, block=mixing.BLOCK_WORDS, seed=mixing.SEED):
    """What the mix takes of each document, slot by slot in plain Python: (id, digest, words taken) of all rows."""
    streams = defaultdict(list)
    for d, t, _, source, _ in rows:
        digest = hashlib.md5((t or "").encode()).hexdigest()
        streams[source].append(((d is not None, d or 0), digest, len(WORD.findall(t or ""))))
    targets, out = mixing.targets({s: sum(n for *_, n in docs) for s, docs in streams.items()}), []
    for number, source in enumerate(sorted(streams, key=lambda s: (s is None, s or ""))):
        documents = sorted(streams[source])
        owner = [i for i, (*_, n) in enumerate(documents) for _ in range(n)]
        blocks = -(-len(owner) // block)
        taken = [0] * len(documents)
        slots = min(3 * blocks, round(targets[source] * blocks / len(owner))) if blocks else 0
        for slot in range(slots):
            key = seed * 1_000_003 + number * 8191 + slot // blocks
            at = int(mixing.permuted(np.array([slot % blocks]), blocks, key)[0])
            for i in owner[at * block: (at + 1) * block]:
                taken[i] += 1
        out += [(d, digest, n) for (d, digest, _), n in zip(documents, taken)]
    return sorted(out)


def test_taken_words_equal_a_replay(docs, rows):
    taken = mixing.mix_documents(docs).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r["size"], r.taken) for r in taken) == sorted(
        (d, size, n) for (d, digest, n), size in zip(replayed(rows), [
            len(WORD.findall(t or "")) for _, _, t in sorted(
                ((d is not None, d or 0), hashlib.md5((t or "").encode()).hexdigest(), t or "") for d, t, *_ in rows)]))


def test_mixed_texts(docs, rows, empty):
    taken = Counter()
    for r in mixing.mix_documents(docs).collect():
        taken[r.doc_id] += r.taken
    got, originals = Counter(), defaultdict(set)
    for d, t, *_ in rows:
        originals[d].update(WORD.findall(t or ""))
    mixed = mixing.mixed_texts(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        found = WORD.findall(r.text or "")
        assert set(found) <= originals[r.doc_id]
        got[r.doc_id] += len(found)
    assert +got == +taken
    assert mixing.mixed_texts(empty).count() == 0


def test_sources_stay_off_the_driver(spark, docs, rows, monkeypatch):
    """Neither the sources nor what is drawn for them is collected or sent from the driver, and many are not broadcast."""
    whole = sorted(map(repr, mixing.mix_documents(docs).collect()))
    texts = sorted(map(repr, mixing.mixed_texts(docs).collect()))
    many = [(i, f"a{i} b c", "en", f"src{i}", 5) for i in range(3000)]
    with monkeypatch.context() as m:
        m.setattr(mixing, "BROADCAST_SOURCES", 2)
        for frame in {type(docs), DataFrame}:
            m.setattr(frame, "collect", None)
        m.setattr(type(spark), "createDataFrame", None)
        found, mixed = mixing.mix_documents(docs), mixing.mixed_texts(docs)
    assert "strategy=broadcast" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, found.collect())) == whole and sorted(map(repr, mixed.collect())) == texts
    got = mixing.mix_documents(spark.createDataFrame(many, SCHEMA)).collect()
    assert len(got) == 3000 and sum(r.taken for r in got) == pytest.approx(9000, rel=0.2)


def test_short_draws_go_to_the_largest():
    """What draws take beyond the slots of small sources goes to those with most left, as one by one."""
    slots = [1] * 50 + [3, 7, 7, 2]
    left, random = np.array(slots), np.random.default_rng(mixing.SEED)
    for _, counts in mixing.draw_shards(slots, 20):
        n = min(20, int(left.sum()))
        wanted = np.minimum(random.multinomial(n, left / left.sum()), left)
        while (short := n - int(wanted.sum())) > 0:
            at = int((left - wanted).argmax())
            wanted[at] += min(short, int((left - wanted)[at]))
        assert counts.tolist() == wanted.tolist()
        left = left - wanted
    assert not left.any()


# --- substring dedup ---------------------------------------------------------------------------------------------


def brute_dedup(rows, window, tie):
    seen, out = set(), {}
    documents = {((d if d is not None else substring_dedup.LAST), t or "") for d, t, *_ in rows}
    for d, t in sorted(documents, key=lambda x: (x[0], tie[x[1]])):
        w = WORD.findall(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            run = tuple(w[i: i + window])
            if run in seen:
                gone[i: i + window] = [True] * window
            seen.add(run)
        left = " ".join(x for x, g in zip(w, gone) if not g)
        out[(d, t)] = (len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest(), left)
    return out


def test_dedup_substrings(spark, docs, rows, clashing, empty):
    from pyspark.sql import functions as F

    tie = {r.t: r.k for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << substring_dedup.KEY_BITS)).alias("k")).collect()}
    for window in (20, 8):
        expected = brute_dedup(rows, window, tie)
        for df in (docs, clashing):
            got = substring_dedup.dedup_substrings(df, window).collect()
            key = lambda r: repr(r)
            want = [(d, *expected[(d if d is not None else substring_dedup.LAST, t or "")][:3]) for d, t, *_ in rows]
            assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = substring_dedup.without_repeats(docs)
    assert kept.columns == docs.columns
    expected = brute_dedup(rows, 20, tie)
    want = Counter()
    for d, t, *_ in rows:
        n, gone, _, left = expected[(d if d is not None else substring_dedup.LAST, t or "")]
        if gone < n or not n:
            want[(d, left if gone else t)] += 1
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_hot_passage(spark, monkeypatch):
    """A passage that most documents share, with every threshold for frequent anchors reached."""
    monkeypatch.setattr(substring_dedup, "HOT_COUNT", 5)
    monkeypatch.setattr(substring_dedup, "GROUP", 4)
    rng = random.Random(9)
    passage = " ".join(words(rng, 50))
    rows = [(i, " ".join(words(rng, rng.randrange(30))) + " " + passage + " " + " ".join(words(rng, rng.randrange(30)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = brute_dedup(rows, 20, {t: 0 for _, t in rows})
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(df).collect()}
    assert got == {d: expected[(d, t)][:3] for d, t in rows}


@pytest.mark.parametrize("bits", [0, 3])
def test_texts_with_one_key(spark, monkeypatch, bits):
    """Keys of few bits: many texts of all lengths share one, also under one id."""
    monkeypatch.setattr(substring_dedup, "KEY_BITS", bits)
    monkeypatch.setattr(substring_dedup, "GROUP", 4)
    from pyspark.sql import functions as F

    rng = random.Random(11)
    passages = [" ".join(words(rng, 45, 50_000)) for _ in range(6)]
    texts = []
    for _ in range(70):
        parts = [" ".join(words(rng, rng.randrange(1, 60), 50_000)) for _ in range(rng.randrange(1, 4))]
        texts.append(" ".join(x for p in parts for x in (p, rng.choice(passages))))
    texts += texts[:5] + ["short text", "", None]
    rows = [(rng.randrange(50), t) for t in texts]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    content = F.coalesce("text", F.lit(""))
    tie = {r.t: (r.k, r.d) for r in df.select(
        content.alias("t"), F.pmod(F.xxhash64(content), F.lit(1 << bits)).alias("k"), F.md5(content).alias("d")).collect()}
    expected = brute_dedup(rows, 20, tie)
    got = Counter(map(tuple, substring_dedup.dedup_substrings(df).collect()))
    assert got == Counter((d, *expected[(d, t or "")][:3]) for d, t in rows)


def test_texts_are_taken_apart_once(spark):
    """One pass counts anchors, one finds the repeated ones, and windows are made once, for both of their uses."""
    import re

    df = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id bigint, text string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = substring_dedup.dedup_substrings(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    made = re.findall(r"MapInArrow emit\(([^)]*)\)", plan)
    assert sorted(m.count("#") for m in made) == [2, 2, 4], made


# --- Jaccard join ------------------------------------------------------------------------------------------------


def brute_links(rows, percent, n):
    sets = {}
    for d, t, *_ in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")]
        found = frozenset(tuple(w[i: i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
        sets.setdefault(d, []).append((t, found))
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(d for d in sets if d is not None)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(100 * len(x & y) >= percent * len(x | y) for _, x in sets[a] for _, y in sets[b] if x and y):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    size = {(d, t): len(s) for d, all_of in sets.items() for t, s in all_of}
    return [(d, size[(d, t)], (d if not size[(d, t)] else root(d)) if d is not None else None) for d, t, *_ in rows]


@pytest.mark.parametrize("percent,shingle", [(85, 4), (80, 5), (50, 1)])
def test_link_documents(docs, rows, clashing, percent, shingle):
    key = repr
    expected = sorted(brute_links(rows, percent, shingle), key=key)
    for df in (docs, clashing) if percent == 85 else (docs,):
        got = jaccard_join.link_documents(df, percent, shingle).collect()
        assert sorted(map(tuple, got), key=key) == expected


def test_links_between_groups_of_near_copies(spark):
    """Chains of edits, so that links lead on where similarity to the first document ends."""
    rng = random.Random(8)
    rows, n = [], 0
    for _ in range(6):
        w = words(rng, 60, 1000)
        for _ in range(25):
            w = list(w)
            w[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard_join.link_documents(df).collect())) == sorted(brute_links(rows, 85, 4))


def test_empty_join(empty):
    assert jaccard_join.link_documents(empty).count() == 0


def test_divide_skip():
    rng = random.Random(7)
    for _ in range(200):
        lists = [sorted(rng.sample(range(40), rng.randrange(0, 40))) for _ in range(rng.randrange(1, 12))]
        counts = Counter(x for members in lists for x in members)
        least = rng.randrange(1, len(lists) + 2)
        expected = {x: n for x, n in counts.items() if n >= least}
        assert jaccard_join.divide_skip(lists, least) == expected
        assert jaccard_join.merge_skip(lists, least) == expected


def test_components(spark):
    links = [(i, i + 1) for i in range(40) if i != 20] + [(50, 60), (60, 70), (70, 50), (80, 80)]
    nodes = [*range(41), 50, 60, 70, 80, 90]
    got = dict(map(tuple, components(
        spark.createDataFrame([(x,) for x in nodes], "node bigint"), spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {x: 0 if x <= 20 else 21 if x <= 40 else 50 if x < 80 else x for x in nodes}


def brute_kept(rows, percent, n):
    """Texts by id that stay: one of each component of linked sets, judged text by text."""
    texts = sorted({(d, t or "") for d, t, *_ in rows if d is not None}, key=lambda x: (x[0], hashlib.md5(x[1].encode()).digest()))
    sets = [shingle_set(t, n) for _, t in texts]
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return [x for i, x in enumerate(texts) if group[i] == i]


def shingle_set(text, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i: i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_pairs_that_sketches_rule_out(spark, monkeypatch):
    """Copies that share most lists but are not near enough: few of the pairs are compared by their whole sets."""
    rng = random.Random(4)
    base = words(rng, 200, 100_000)
    rows = []
    for i in range(40):
        text = list(base)
        at = rng.randrange(190)
        text[at: at + 9] = words(rng, 9, 10_000_000)
        rows.append((i, " ".join(text)))
    compared, verified = [], jaccard_join._verified

    def counting(pairs, *more):
        compared.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(jaccard_join, "_verified", counting)
    got = jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_links(rows, 85, 4))
    assert sum(compared) < 200  # of 780


def test_one_of_each(spark, docs, rows, empty):
    short = [r for r in rows if len(r[1] or "") < 20_000]
    for given, df in ((rows, docs), (short, docs.where("char_length(coalesce(text, '')) < 20000"))):
        kept = jaccard_join.one_of_each(df).collect()
        assert sum(r.doc_id is None for r in kept) == sum(d is None for d, *_ in given)
    assert sorted((r.doc_id, r.text or "") for r in kept if r.doc_id is not None) == sorted(brute_kept(short, 85, 4))
    # texts that share an id and are linked with nothing all stay
    same_id = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (1, "one two three four five"), (2, "one two three four five"), (3, None), (3, "")],
                                    "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard_join.one_of_each(same_id).select("doc_id", F.coalesce("text", F.lit(""))).collect())) == [
        (1, "alpha beta gamma delta epsilon"), (1, "one two three four five"), (3, "")]
    assert jaccard_join.one_of_each(empty).count() == 0


OWN_NAMES = ["parts", "_copies", "_source", "_name", "_texts", "_digest", "_rank", "_row", "_doc", "_key", "_stays", "_place", "key", "n", "digest", "id",
             "label", "node", "first", "_own", "_one", "_id"]


def test_stages_keep_columns_of_any_name(clashing):
    more = clashing.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce("text", F.lit(""))) for c in OWN_NAMES if c not in clashing.columns})
    added = [c for c in OWN_NAMES if c not in clashing.columns]
    for stage in (jaccard_join.one_of_each, mixing.mixed_texts, substring_dedup.without_repeats):
        got = stage(more)
        assert got.columns == more.columns
        wrong = got.where(" or ".join(f"`{c}` is null or not startswith(`{c}`, '{c} of ')" for c in added))
        assert got.count() > 0 and wrong.count() == 0


# --- pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline(spark, docs, tmp_path):
    sf_dir = f"file://{tmp_path}"
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "substring_dedup", "mixing", "packing"]
    at = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, by_hand = at.columns, []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf_dir)
        at.write.parquet(f"{sf_dir}/{name}")
        at = spark.read.parquet(f"{sf_dir}/{name}")
        by_hand.append(at.count())
        assert name == "packing" or at.columns == columns
    assert corpus_pipeline.run(spark, sf_dir).count() > 0 and min(by_hand) > 0


def test_pipeline_stages(spark, rows, tmp_path):
    """Each stage's rows against plain Python on its own input, with labelled toxic rows."""
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    rng = random.Random(12)
    bad, more = {"idiot", "moron", "scum"}, []
    for i in range(300):
        w = words(rng, 30, 5000)
        if i % 4 == 0:
            w[3], w[20] = rng.sample(sorted(bad), 2)
        more.append((10_000 + i, " ".join(w), "en", f"src{i % 3}", len(" ".join(w))))
    sf_dir = f"file://{tmp_path}"
    spark.createDataFrame([*rows, *more], SCHEMA).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d % 4 == 0)) for d, *_ in more], "doc_id bigint, quality int, toxic int").write.parquet(
        f"{sf_dir}/labels.parquet")
    seen = {"documents.parquet": spark.read.parquet(f"{sf_dir}/documents.parquet")}
    for (name, stage), at in zip(corpus_pipeline.STAGES, ["documents.parquet", *(name for name, _ in corpus_pipeline.STAGES)]):
        stage(spark, seen[at], sf_dir).write.parquet(f"{sf_dir}/{name}")
        seen[name] = spark.read.parquet(f"{sf_dir}/{name}")
    packed = seen.pop("packing").collect()
    documents, clean, single, cut, mixed = ([tuple(r) for r in df.collect()] for df in seen.values())

    assert Counter(clean) == Counter(r for r in documents if not bad & set(WORD.findall(r[1] or "")))
    assert len(documents) - len(clean) == 75

    assert Counter((r[0], r[1] or "") for r in single if r[0] is not None) == Counter(brute_kept(clean, 80, 5))
    assert Counter(r for r in single if r[0] is None) == Counter(r for r in clean if r[0] is None)
    assert not Counter(single) - Counter(clean) and len(single) < len(clean)

    content = F.coalesce("text", F.lit(""))
    tie = {r.t: r.k for r in seen["near_copies"].select(
        content.alias("t"), F.pmod(F.xxhash64(content), F.lit(1 << substring_dedup.KEY_BITS)).alias("k")).collect()}
    expected, want = brute_dedup(single, 20, tie), Counter()
    for d, t, lang, source, _ in single:
        n, gone, _, left = expected[(d if d is not None else substring_dedup.LAST, t or "")]
        if gone < n or not n:
            text = left if gone else t
            want[(d, text, lang, source, None if text is None else len(text))] += 1
    assert Counter(cut) == want and any(gone for _, gone, *_ in expected.values())

    sizes, taken, had, got = Counter(), Counter(), defaultdict(Counter), defaultdict(Counter)
    for d, t, _, source, _ in cut:
        sizes[source] += len(WORD.findall(t or ""))
        had[d].update(WORD.findall(t or ""))
    for d, t, _, source, _ in mixed:
        taken[source] += len(WORD.findall(t or ""))
        got[d].update(WORD.findall(t or ""))
    for source, n in mixing.targets(sizes).items():
        assert abs(taken[source] - n) <= 2 * mixing.BLOCK_WORDS
    assert all(n <= 3 * had[d][w] for d, found in got.items() for w, n in found.items())

    library, ids = Tokenizer.from_file(TOKENIZER), defaultdict(list)
    for d, t, *_ in mixed:
        ids[d].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes())
    filled, total = Counter(), Counter()
    for r in packed:
        piece = bytes(r.ids)
        assert any(len(x) == 4 * r.doc_tokens and x[4 * r.start: 4 * r.start + len(piece)] == piece for x in ids[r.doc_id])
        filled[r.sequence_id] += r.length
        total[r.doc_id] += r.length
    assert max(filled.values()) <= 2048 and total == Counter({d: sum(map(len, x)) // 4 for d, x in ids.items()})


def test_plain_words_go_to_the_model_of_the_tokenizer(monkeypatch):
    """With the same ids as those of the whole tokenizer."""
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        encode = packing.Encoder(file.read(), split_at_spaces=True)
    plain = ["a", "Über", "ÉTÉ,", "naïve!?", "end.)", "Strasse", "straße;", "a~", "x_", "µ", "ÿ"]
    other = ["don't", "it's", "<b>", "a<|endoftext|>", "ªº", "Ελλάς", "İx", "e\u0301", "a1", "12", "x_y", "×", ",", "ŒUF"]
    seen, by_text = [], encode._by_text
    monkeypatch.setattr(encode, "_by_text", lambda words: seen.extend(words) or by_text(words))
    texts = [" ".join(plain + other), " ".join(reversed(plain))]
    ids = [np.frombuffer(x, dtype=encode.kind).tolist() for x in encode(texts)]
    assert ids == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(seen) == sorted([*other, "µ"])
