import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns with names that operators might use inside.
CLASHING = ["key", "digest", "size", "score", "label", "words", "row", "group", "first", "n", "chunk", "node", "shard", "rank"]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def make_rows():
    """Plain texts, copies, near copies, shared passages, junk, nulls, blanks, repeated rows and ids, one very long text."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 60))
    texts = [" ".join(words(rng, rng.randrange(1, 150))) for _ in range(60)]
    texts += [texts[3]] * 6 + [texts[7]] * 2
    base = words(rng, 120, 100_000)
    for i in range(12):
        near = list(base)
        near[i * 9] = "edit"
        texts.append(" ".join(near))
    texts += [f"{' '.join(words(rng, 15))}\n{passage}\t{' '.join(words(rng, 10))}" for _ in range(10)]
    texts += [None, "", "   \n\t", "one", "a b c", "A B C", "ß é x   y", "!! ## **", "x " * 70, "same line\n" * 30]
    texts.append(" ".join(words(rng, 30_000, 5000)))
    rows = [(i * 3 + 1, t, "en", f"src{i % 4}" if i % 9 else "hot", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, texts[0], "en", None, 5), (None, None, None, None, None), rows[10], rows[10], (rows[12][0], "another text", "de", "hot", 12)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in CLASHING})


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is not None, str(type(x)), x) for x in r])
