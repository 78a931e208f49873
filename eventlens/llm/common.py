"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of other characters than these: blank, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN))


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text is divisible by five; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def document_key(doc_id: Column, text: Column) -> Column:
    """Key of a document even if ids repeat: equal id and equal text are one document."""
    return F.struct(doc_id.alias("doc_id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("digest"))


def split_words(text: str | None) -> list[str]:
    """The same words in Python; str.split() alone would also cut at other Unicode spaces."""
    if not text:
        return []
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    for c in SPACES[1:]:
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def slices(batches, *columns: int, rows: int = 256):
    """Values of some columns of Arrow batches as lists, for a few rows at a time: a batch of long texts is not held twice."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield tuple(part.column(c).to_pylist() for c in columns)


#: Rows of an id and a number that may be broadcast, some 100 MB in memory; larger tables are shuffled.
BROADCAST_ROWS = 2_000_000


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join on doc_id with a table of labels. Texts need not move while the labels, counted first, are few."""
    return docs.join(F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels, "doc_id")
