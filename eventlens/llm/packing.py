"""Cost-balanced packing: documents in descending order go to the cheapest sequence that still has room.

A sequence of documents costs a linear part per token and a quadratic part per document, as attention does not cross
document borders. Putting the next largest piece where the cost is lowest evens out the time that each sequence takes.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import split_words, utf8_bytes

LENGTH, END = 2048, 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024  # cost of a token, and of a pair of tokens of one document
GROUP_BYTES = 2 << 20  # text that is packed together, about 300 sequences; each group wastes less than one sequence
CACHE_WORDS = 400_000

#: Tokenizers that begin so hand their model the letters of a word in lower case and then its signs, byte by byte.
LETTERS_THEN_SIGNS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: Letters that NFC leaves as they are, and ASCII signs but for those that begin endings or special tokens.
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")
#: How byte-level models write bytes: printable ones of Latin-1 as themselves, the others by characters from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES_AS_TEXT = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}

_LOADED: dict[bytes, Encoder] = {}


class Encoder:
    """Ids of whole texts as little-endian bytes of `width` each, equal to the library's own.

    For tokenizers that drop white space (`split_at_spaces`), a text's ids are those of its words in a row. A bounded
    number of words is remembered; new ones are encoded together, parted by a special token that no word contains. Where it
    is known how the tokenizer takes words apart (LETTERS_THEN_SIGNS), plain words go to its model directly.
    """

    def __init__(self, model: bytes, split_at_spaces: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split_at_spaces, self.known = split_at_spaces, {}
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        special = sorted((i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items()
                         if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word))
        self.parting = (special[0][0], special[0][1].content) if special else None
        steps = json.loads(model)
        self.plain = all(steps.get(step) == how for step, how in LETTERS_THEN_SIGNS.items()) and all(
            t.special and t.content.startswith("<") for _, t in self.tokenizer.get_added_tokens_decoder().items())

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in found]

    def _plain(self, words: list[str]) -> tuple[dict[str, bytes], list[str]]:
        """Ids of the plain words, and the other words."""
        tokenize, parts, found, others = self.tokenizer.model.tokenize, {}, {}, []
        for word in words:
            split = PLAIN_WORD.fullmatch(word)
            if split is None:
                others.append(word)
                continue
            ids = b""
            for part in split.groups():
                if part and part not in parts:
                    written = part.lower().encode("utf-8").decode("latin-1").translate(BYTES_AS_TEXT)
                    parts[part] = b"".join([t.id.to_bytes(self.width, "little") for t in tokenize(written)])
                ids += parts.get(part, b"")
            found[word] = ids
        return found, others

    def _words(self, words: list[str]) -> dict[str, bytes]:
        if not self.plain:
            return self._by_text(words)
        found, others = self._plain(words)
        return found | self._by_text(others)

    def _by_text(self, words: list[str]) -> dict[str, bytes]:
        if self.parting is None:
            return dict(zip(words, self._whole(words)))
        parting, mark = self.parting
        odd = [w for w in words if "<" in w or mark in w]
        plain = [w for w in words if not ("<" in w or mark in w)]
        found = dict(zip(odd, self._whole(odd)))
        for start in range(0, len(plain), 2000):
            part = plain[start: start + 2000]
            # of a batch, as that alone leaves out the places of the ids in the text
            together = self.tokenizer.encode_batch_fast([mark.join(part)], add_special_tokens=False)[0]
            ids = np.array(together.ids, dtype=np.int64)
            cuts = np.flatnonzero(ids == parting)
            data, ends = ids[ids != parting].astype(self.kind).tobytes(), cuts - np.arange(len(cuts))
            at = [0, *(ends * self.width).tolist(), len(data)]
            found.update(zip(part, (data[a:b] for a, b in zip(at, at[1:]))))
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.split_at_spaces:
            return self._whole(texts)
        split = [split_words(t) for t in texts]
        known = self.known
        ids = [[*map(known.get, words)] for words in split]  # each word is looked up once
        some = [i for i, found in enumerate(ids) if None in found]
        new = self._words(list({w for i in some for w, x in zip(split[i], ids[i]) if x is None}))
        for i in some:
            ids[i] = [new[w] if x is None else x for w, x in zip(split[i], ids[i])]
        if len(known) < CACHE_WORDS:
            known.update(new)
        return [b"".join(found) for found in ids]


def encoder(model: bytes, split_at_spaces: bool) -> Encoder:
    """One per Python worker, kept from task to task."""
    if model not in _LOADED:
        _LOADED.clear()
        _LOADED[model] = Encoder(model, split_at_spaces)
    return _LOADED[model]


def _encode(model: bytes, split_at_spaces: bool, end: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(model, split_at_spaces)
        last = np.array([end], dtype=encode_texts.kind).tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                ids = [x + last for x in encode_texts(part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(ids, pa.binary())],
                    names=["group", "row", "doc_id", "ids"])

    return encode


def balance(sizes: list[int], length: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """Pieces (item, start, size, sequence) of items of at most `length` tokens in as few sequences as can hold them.

    Items come in descending order; each goes to the cheapest sequence with room for it. Where none has, it is cut: the
    cheapest sequences with any room take what they can.
    """
    n = math.ceil(sum(sizes) / length)
    cost, free = np.zeros(n), np.full(n, length, dtype=np.int64)
    pieces = []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        start, left = 0, sizes[item]
        while left:
            room = free >= left
            if not room.any():
                room = free > 0
            at = int(np.where(room, cost, np.inf).argmin())
            take = min(left, int(free[at]))
            pieces.append((item, start, take, at))
            cost[at] += linear * take + quadratic * take * take
            free[at] -= take
            start, left = start + take, left - take
    return pieces


def _pack(width: int, length: int, linear: float, quadratic: float):
    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        ids = [np.frombuffer(x, dtype=f"<u{width}").astype("<u4") for x in group.column("ids").to_pylist()]
        base = group.column("group")[0].as_py() << 32
        whole = [(d, s, length, q) for q, (d, s) in enumerate(
            (d, s) for d, x in enumerate(ids) for s in range(0, len(x) - length + 1, length))]
        tails = [(d, len(x) - len(x) % length, len(x) % length) for d, x in enumerate(ids) if len(x) % length]
        rest = [(tails[i][0], tails[i][1] + s, n, len(whole) + q)
                for i, s, n, q in balance([t[2] for t in tails], length, linear, quadratic)]
        filled, offsets, pieces = {}, [], whole + rest
        for _, _, n, sequence in pieces:
            offsets.append(filled.get(sequence, 0))
            filled[sequence] = offsets[-1] + n
        return pa.table({
            "doc_id": group.column("doc_id").take(pa.array([p[0] for p in pieces], pa.int64())),
            "start": pa.array([p[1] for p in pieces], pa.int64()),
            "length": pa.array([p[2] for p in pieces], pa.int64()),
            "ids": pa.array([ids[d][start: start + n].tobytes() for d, start, n, _ in pieces], pa.binary()),
            "doc_tokens": pa.array([len(ids[p[0]]) for p in pieces], pa.int64()),
            "sequence_id": pa.array([base + p[3] for p in pieces], pa.int64()),
            "offset": pa.array(offsets, pa.int64()),
        })

    return pack


def pack_documents(
    docs: DataFrame, model: bytes, length: int = LENGTH, end: int = END, split_at_spaces: bool = False,
    linear: float = LINEAR, quadratic: float = QUADRATIC, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Pieces of all documents in sequences of at most `length` ids, with the ids as little-endian 32-bit integers.

    A document is the ids of its text and `end`. Null and empty texts are that one id. Full lengths of a document are
    sequences of their own, what is left of it is packed. Rows are dealt by hash into groups of about `group_bytes` of
    text, each packed in one task; all its sequences are full but for less than one sequence of padding. Rows count one
    by one, even if ids repeat or are null; copies are spread over the groups. Other columns than doc_id and text are
    not read. A sequence id is unique; its upper half is the group.
    """
    total = docs.agg(F.coalesce(F.sum(utf8_bytes(F.col("text"))), F.lit(0))).first()[0]
    groups = max(1, math.ceil(total / group_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = numbered.select(
        F.pmod(F.xxhash64("row", "doc_id"), F.lit(groups)).alias("group"), "row", "doc_id",
        F.coalesce("text", F.lit("")).alias("text"))
    encoded = rows.mapInArrow(
        _encode(model, split_at_spaces, end), f"group bigint, row bigint, doc_id {kind}, ids binary")
    width = encoder(model, split_at_spaces).width
    return encoded.groupBy("group").applyInArrow(
        _pack(width, length, linear, quadratic),
        f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
