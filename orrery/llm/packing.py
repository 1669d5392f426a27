"""Packing documents into fixed-length training sequences.

First-fit decreasing on a tournament tree of bin capacities. Documents are cut into full sequences and
one rest; the pieces are dealt at random into groups of bounded size, and each group is packed on its own,
so that the work is one small shuffle of piece headers (no text) and grows in proportion to the input.
Documents that fit into a sequence stay whole: in groups of this size first-fit decreasing leaves hardly
any padding, and cutting them as well would gain nothing.

Defined results: a null or empty text is the document of the end id alone; repeated rows are packed each
for itself; an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

LENGTH = 2048
END_ID = 1
#: Documents to a group: a task packs one group at a time, in memory.
GROUP = 2048
#: Bytes that a Python worker may take to remember the ids of words; beyond that it starts anew. A task forgets them at its end.
CACHE_BYTES = 48 << 20
#: Of an entry, besides word and ids.
_ENTRY_BYTES = 170

PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
PIECE = ", ".join(f"{n} long" for n in PIECE_NAMES)
PACKED = PIECE + ", sequence_id long, offset long"


#: ASCII signs that follow a word; the pre-tokenizer parts them from its last letter.
SIGNS = ".,!?;:|*&%$#-_=+()[]{}<>\"'~^/`@\\"


def _byte_letters() -> str:
    """The letter that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(other)) for b in range(256))


class WordIds(dict):
    """Ids of each word as little-endian unsigned 32-bit bytes.

    Holds for tokenizers that work as word_bpe_49k does: NFC and lower case by character, no token over white
    space, runs of letters apart from signs, byte-level BPE. A text's ids are then those of its words in
    turn. Words of letters alone go to the BPE model itself, all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.held = 0

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def __missing__(self, word: bytes) -> bytes:
        if self.held >= CACHE_BYTES:
            self.clear()
        text = word.decode("utf-8")
        packed = self._letters(text) if text.isalpha() else None
        if packed is None:
            core = text.rstrip(SIGNS)
            if len(core) < len(text) and core[-1:].lower()[-1:].isalpha() and b"<|" not in word:
                packed = self[core.encode()] + self[text[len(core) :].encode()]
            else:
                packed = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self[word] = packed
        self.held += len(word) + len(packed) + _ENTRY_BYTES
        return packed

    def _letters(self, text: str) -> bytes | None:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                return None
            text = "".join(c.lower() for c in text)
            if not text.isalpha():
                return None
            text = text.encode().decode("latin-1").translate(self.letters)
        elif not text.islower():
            return None
        return np.array([t.id for t in self.model.tokenize(text)], dtype="<u4").tobytes()

    def of(self, text: str | None) -> bytes:
        data = (text or "").encode("utf-8", "replace")
        if b"<|" not in data:  # special tokens are told by case
            data = data.lower()
        return b"".join(map(self.__getitem__, data.split()))


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


class CapacityTree:
    """A tournament tree over bins in the order they were opened: the winner of a match is the larger free capacity."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """Put size into the first bin that can hold it; its number."""
        free, k, leaves = self.free, 1, self.leaves
        while k < leaves:
            k *= 2
            if free[k] < size:
                k += 1
        at = k - leaves
        free[k] -= size
        while k > 1:
            k //= 2
            best = max(free[2 * k], free[2 * k + 1])
            if free[k] == best:
                break
            free[k] = best
        return at


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """The bin of each size, and the number of bins. Ties keep their order."""
    tree, bins, used = CapacityTree(len(sizes), capacity), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i] = tree.take(sizes[i])
        used = max(used, bins[i] + 1)
    return bins, used


def _cut(batches: Iterable[pa.RecordBatch], path: str, end_id: int, length: int) -> Iterator[pa.RecordBatch]:
    """Tokenize; a row for each piece."""
    words, end = word_ids(path), np.array([end_id], dtype="<u4").tobytes()
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = words.of(text.as_py()) + end
            total = len(ids) // 4
            for start in range(0, total, length):
                piece = ids[4 * start : 4 * (start + length)]
                rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 5)], names=PIECE_NAMES)
    words.clear()


def pack_group(pieces: list[tuple], length: int) -> list[tuple]:
    """Pieces (doc_id, start, length, crc, doc_tokens) to rows with the number of their sequence and the offset there."""
    full = [(*p, k, 0) for k, p in enumerate(p for p in pieces if p[2] == length)]
    rests = [p for p in pieces if p[2] < length]
    bins, used = first_fit_decreasing([p[2] for p in rests], length)
    filled = [0] * used
    for p, b in zip(rests, bins, strict=True):
        full.append((*p, len(pieces) - len(rests) + b, filled[b]))
        filled[b] += p[2]
    return full


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """One row for each piece of each document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    groups = max(1, math.ceil(docs.count() / group))
    pieces = docs.mapInArrow(lean(lambda batches: _cut(batches, vocabulary, end_id, length)), PIECE)
    # By partition too, so that rows that equal one another in everything do not all meet in one group.
    pieces = pieces.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.spark_partition_id()), F.lit(groups)))

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        order = sorted(zip(*(rows.column(n).to_pylist() for n in PIECE_NAMES), strict=True), key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1], p[3]))
        out = [(*r[:5], (key[0].as_py() << 32) + r[5], r[6]) for r in pack_group(order, length)]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=[*PIECE_NAMES, "sequence_id", "offset"])

    return pieces.groupBy("bin_group").applyInArrow(packed, PACKED)
