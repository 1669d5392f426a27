"""Removal of long byte strings that occur more than once in a corpus.

Hashes narrow the corpus down to windows that may occur again; the interval expansion decides on every one of them.

1. Anchors. Each window of `length` bytes has an anchor, the place in it of the smallest hash of `gram` bytes
   (the leftmost of equals). Equal windows have equal anchors, so windows whose anchor's gram occurs once in
   the corpus are unique. Neighbouring windows with the same anchor form a stretch: one row of hashes for
   about 170 bytes of text. Rows are counted by (gram, whole stretch).
2. Stretches whose hash occurs again form a class. Two of its members, the first and the last, go to the shard of
   the first one's block of 64 kB of its document; neighbouring stretches go as one run of text, so that little
   is sent twice. The class is repeated if the expansion finds every window of its first member again.
3. Stretches that share their gram with other, different ones lie at the edges of repeated passages. One of each
   text is dealt by the distance of its windows from the anchor into sections, whose windows share a core of
   `length` - SECTION + 1 bytes. Equal windows have equal cores, so a section whose core occurs once is unique.
   Texts of the sections left go to shards by gram.
   A gram with more sections than a shard may hold is taken apart: its windows are counted by hashes, formed
   before the shuffle, so that one very common passage is spread over all tasks; those whose hash occurs again
   form classes, of which two members each are compared as in 2.
4. A shard is indexed: suffixes sorted up to `length`, the Burrows-Wheeler transform, and a breadth-first backward
   extension of intervals, which sets common prefixes by increasing value and stops at `length`; entries not set by
   then are longer. A window is repeated if its suffix shares `length` bytes with a neighbour in the order.
5. Repeated windows by document give the bytes to remove.

Passages of words. 400 bytes are some 62 words of English, so a passage of a little over 50 words may be shorter.
With `words`, the same five steps run over the words: each word is CODE bytes of its hash, a window is that many
codes, and runs of windows that begin at a code are runs of words (what separates words may differ); of a gram that
is taken apart only those windows are counted. Strings
of `length` bytes that surely hold fewer whole words (long words, scripts without spaces) are then looked for among
themselves, as bytes; any other string of `length` bytes that occurs again holds a passage of so many words.

Windows never cross documents: a stretch lies within one. Documents are told apart by id and a hash of the text,
members of a class from others by 128 bits of hash.

Defined results: a null text is empty; texts of fewer than `length` bytes lose nothing; rows that repeat an id
or whole rows count as documents of their own, so their text repeats; an empty table gives no rows; columns
other than those named are ignored (`cut` keeps them, whatever their names).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import forget, give_back, in_doubt_of, lean, ragged, renamed, stored

LENGTH, GRAM = 400, 64
#: Windows that a section spans.
SECTION = 32
#: Bytes of text aimed at in a shard; sections of one gram beyond which its windows are taken apart.
SHARD_BYTES, MOST_SECTIONS = 1 << 20, 2048
#: Texts of stretches that occur more often, and in more than that share of all stretches, are broadcast (under 20 MB).
FREQUENT, MOST_FREQUENT = 64, 100_000
#: Bytes of a text that are looked at together.
PIECE = 1 << 20
#: Bits of a stretch's place for its last window, and for its anchor, from its first window.
SPAN_BITS = 12
#: Bits of the windows of a document whose repeated stretches are decided together (64 kB).
BLOCK_BITS = 16
#: Bytes of a word's hash in texts that are compared by words, and words of a gram there.
CODE, GRAM_WORDS = 6, 8
_B = 0x9E3779B97F4A7C15 | 1
_BI = pow(_B, -1, 1 << 64)


def _powers(base: int, n: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    found = kept.get(base)
    if found is None or found.size < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        kept[base] = found = np.multiply.accumulate(out)
    return found[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of data[i : i + gram] for each i."""
    n = data.size
    with np.errstate(over="ignore"):
        run = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_B, n), out=run[1:])
        h = (run[gram:] - run[:-gram]) * _powers(_BI, n - gram + 1)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        return h ^ (h >> np.uint64(29))


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest (leftmost of equals) of h[i : i + width] for each i."""
    n = h.size - width + 1
    blocks = -(-h.size // width)
    key = (h & ~np.uint64(0xFFFFF)) | np.arange(h.size, dtype=np.uint64)  # PIECE bounds the index
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: h.size] = key
    grid = padded.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & np.uint64(0xFFFFF)).astype(np.int64)


def stretches(data: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(gram hash, first window, last window, anchor) of the stretches of a text, piece by piece."""
    whole = np.frombuffer(data, np.uint8)
    step = PIECE - length
    for at in range(0, whole.size - length + 1, step):
        part = whole[at : min(at + step + length - 1, whole.size)]
        if part.size < length:
            return
        h = gram_hashes(part, gram)
        least = sliding_least(h, length - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [least.size]]) - 1
        yield h[least[first]], first + at, last + at, least[first] + at


def _rows(batches: Iterable[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    names = ["uid", "id", "gram", "whole", "place"]
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        uids, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list[list[np.ndarray]] = [[] for _ in names]
        held = 0
        for k in range(batch.num_rows):
            data = batch.column(2)[k].as_buffer()
            for g, first, last, anchor in stretches(data, length, gram):
                whole = np.fromiter((digest(data[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)), np.uint64, g.size)
                place = (((first << SPAN_BITS) | (last - first)) << SPAN_BITS) | (anchor - first)
                for column, part in zip(out, (np.full(g.size, uids[k]), np.full(g.size, ids[k]), g.view(np.int64), whole.view(np.int64), place), strict=True):
                    column.append(part)
                held += g.size
            if held > 1 << 16 or (held and k == batch.num_rows - 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=names)
                out, held = [[] for _ in names], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=names)


def sort_suffixes(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of text in the order of their first `length` symbols (ties in any order): prefix multiplying.

    A key of 63 bits holds as many ranks as fit, so that each round of one sort lengthens the sorted prefix
    several times.
    """
    n = text.size
    if n == 0:
        return np.zeros(0, np.int64)
    present = np.bincount(text) > 0
    code = (np.cumsum(present) - 1).astype(np.uint8 if present.sum() < 257 else np.uint16)[text]
    wide = max(1, int(present.sum() - 1).bit_length())
    h = 63 // wide
    padded = np.concatenate([code, np.zeros(h, code.dtype)])
    key = np.zeros(n, np.uint64)
    for k in range(h):
        key <<= np.uint64(wide)
        key |= padded[k : k + n]
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    del key, ordered, padded, code
    start = np.flatnonzero(new)
    rank = np.zeros(n + 1, np.uint32)  # of a group: its first place, and one; 0 beyond the end
    rank[order] = np.repeat(start + 1, np.diff(start, append=n))
    bits = (n + 1).bit_length()
    while h < length:
        size = np.diff(start, append=n)
        at = np.flatnonzero(np.repeat(size > 1, size))
        if not at.size:
            break
        suffix = order[at]
        key = rank[suffix].astype(np.uint64)
        for k in range(1, 63 // bits):
            key <<= np.uint64(bits)
            key |= rank[np.minimum(suffix + k * h, n)]
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[at] = suffix
        head = np.concatenate([[True], key[1:] != key[:-1]])
        new[at] = head
        rank[suffix] = np.repeat(at[head] + 1, np.diff(np.flatnonzero(head), append=at.size))
        start = np.flatnonzero(new)
        h *= 63 // bits
    return order


def long_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether suffix order[i] shares at least `length` symbols with order[i - 1], for each i (0: False).

    Intervals of the Burrows-Wheeler transform are extended backwards, breadth first: the interval of a string
    of l symbols gives those of its extensions by one. The end of an extension's interval is where strings
    that share only l symbols part, so entries are set in the order of their value; each interval is extended
    only if it sets an entry. After `length` rounds what is not set is longer.
    """
    n = text.size
    if n == 0:
        return np.zeros(0, bool)
    symbol = text[order - 1]  # the text is taken as a circle; its last symbol is the least and occurs once
    move = np.empty(n, np.int64)  # of a place in the order: that of the suffix one longer
    move[np.argsort(symbol, kind="stable")] = np.arange(n)  # a radix sort, as symbols have 16 bits
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    left, right = np.zeros(1, np.int64), np.full(1, n)
    for _ in range(length):
        if not left.size:
            break
        size = right - left
        one = size == 1
        # A single suffix has one extension.
        l1 = move[left[one]]
        r1 = l1 + 1
        many = ~one
        if many.any():
            size = size[many]
            total = int(size.sum())
            base = np.cumsum(size) - size
            owner = np.repeat(np.arange(size.size), size)
            place = np.arange(total) - base[owner] + left[many][owner]
            to = move[place]
            by = np.argsort(owner * n + to)
            to, owner, sign = to[by], owner[by], symbol[place[by]]
            head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (sign[1:] != sign[:-1])]))
            tail = np.concatenate([head[1:], [total]]) - 1
            l1, r1 = np.concatenate([l1, to[head]]), np.concatenate([r1, to[tail] + 1])
        fresh = unset[r1]
        l1, r1 = l1[fresh], r1[fresh]
        unset[r1] = False
        left, right = l1, r1
    return unset[:n]


def repeated_windows(parts: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each part: which of its windows occur again, in it or another part."""
    text = np.ones(sum(map(len, parts)) + len(parts) + 1, np.uint16)  # 1 parts them, a single 0 ends it all
    text[-1] = 0
    at, starts = 0, []
    for p in parts:
        text[at : at + len(p)] = np.frombuffer(p, np.uint8)
        text[at : at + len(p)] += 2
        starts.append(at)
        at += len(p) + 1
    order = sort_suffixes(text, length)
    longer = long_prefixes(text, order, length)
    again = np.zeros(text.size, bool)
    both = longer.copy()
    both[:-1] |= longer[1:]
    again[order[both]] = True
    return [again[s : s + c] for s, c in zip(starts, counts, strict=True)]


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


#: What a pass over texts cuts out. Sections (core not null): windows first..last and the hash of their core; the first of a
#: stretch brings its text. Runs (block not null): text of a run of neighbouring stretches from window first on, and the grams,
#: hashes and numbers of windows of those that are to be decided there (none in a run that is only compared with).
PIECES = pa.schema(
    [*((n, pa.int64()) for n in ("uid", "id", "gram", "stretch", "core", "first", "last", "block")), ("text", pa.binary()), *((n, pa.list_(pa.int64())) for n in ("grams", "wholes", "at", "windows"))]
)
PIECES_SQL = "uid long, id long, gram long, stretch long, core long, first long, last long, block long, text binary, grams array<long>, wholes array<long>, at array<long>, windows array<long>"
RUNS_SQL = "block long, text binary, grams array<long>, wholes array<long>, at array<long>, windows array<long>"
FETCHED = pa.schema([*((n, pa.int64()) for n in ("uid", "id", "gram", "core", "first")), ("text", pa.binary()), ("windows", pa.list_(pa.int64()))])
FETCHED_SQL = "uid long, id long, gram long, core long, first long, text binary, windows array<long>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def runs_of(role: np.ndarray, block: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[np.ndarray]:
    """Which stretches of a document make a run: of one role and block, each where the one before ends."""
    order = np.lexsort((first, block, role))
    r, b, f, e = role[order], block[order], first[order], last[order]
    opens = (r[1:] != r[:-1]) | (b[1:] != b[:-1]) | (f[1:] != e[:-1] + 1)
    yield from np.split(order, np.flatnonzero(opens) + 1)


def _cut_out(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of texts (uid, id, data, wanted): sections of the wanted stretches of role 0, runs of those of roles 1 and 2."""
    mask, mixed = (1 << SPAN_BITS) - 1, xxhash.xxh3_64_intdigest
    for batch in batches:
        uids, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ends, of = ragged(batch.column(3))
        first = of["place"] >> 2 * SPAN_BITS
        last = first + ((of["place"] >> SPAN_BITS) & mask)
        anchor = first + (of["place"] & mask)
        rows: list[tuple] = []
        held = 0
        for i in range(batch.num_rows):
            data = batch.column(2)[i].as_py()
            own = slice(ends[i], ends[i + 1])
            role = of["role"][own]
            open_ = np.flatnonzero(role == 0) + ends[i]
            for g, a, z, x in zip(of["gram"][open_].tolist(), first[open_].tolist(), last[open_].tolist(), anchor[open_].tolist(), strict=True):
                text = data[a : z + length]
                held += len(text)
                for k in range((x - z) // SECTION, (x - a) // SECTION + 1):
                    near, far = x - k * SECTION, x - k * SECTION - SECTION + 1  # the section's windows, if all are there
                    core = mixed(data[near : far + length], k)
                    rows.append((uids[i], ids[i], g, a, core - (core >> 63 << 64), max(a, far), min(z, near), None, text, None, None, None, None))
                    text = None
            closed = np.flatnonzero(role > 0) + ends[i]
            if closed.size:
                for run in runs_of(of["role"][closed], of["block"][closed], first[closed], last[closed]):
                    run = closed[run]
                    a, z = int(first[run[0]]), int(last[run[-1]])
                    held += z + length - a
                    asked = run if of["role"][run[0]] == 1 else run[:0]
                    rows.append((uids[i], ids[i], None, None, None, a, None, int(of["block"][run[0]]), data[a : z + length], of["gram"][asked], of["whole"][asked], first[asked] - a, last[asked] - first[asked] + 1))
            if held > 2 << 20 or len(rows) > 1 << 14:
                yield _batch(rows, PIECES)
                rows, held = [], 0
        if rows:
            yield _batch(rows, PIECES)


def _fetch(batches: Iterable[pa.RecordBatch], length: int, unit: int) -> Iterator[pa.RecordBatch]:
    """Of stretches (uid, id, gram, stretch, text, wanted): texts of the wanted sections, neighbours together; of hot ones each, with hashes of its windows that begin at a unit."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        uids, ids, grams, starts = (batch.column(k).to_pylist() for k in range(4))
        ends, of = ragged(batch.column(5))
        rows: list[tuple] = []
        held = 0
        for i in range(batch.num_rows):
            own, text, at = slice(ends[i], ends[i + 1]), batch.column(4)[i].as_py(), starts[i]
            cold: list[list[int]] = []
            for first, last, core, hot in sorted(zip(*(of[n][own].tolist() for n in ("first", "last", "core", "hot")), strict=True)):
                if hot:
                    hashes = np.array([digest(text[s - at : s - at + length]) for s in range(-(-first // unit) * unit, last + 1, unit)], np.uint64).view(np.int64)
                    rows.append((uids[i], ids[i], grams[i], core, first, text[first - at : last - at + length], hashes))
                elif cold and cold[-1][1] + 1 == first:
                    cold[-1][1] = last
                else:
                    cold.append([first, last])
            rows += [(uids[i], ids[i], grams[i], None, first, text[first - at : last - at + length], None) for first, last in cold]
            held += len(text)
            if held > 4 << 20:
                yield _batch(rows, FETCHED)
                rows, held = [], 0
        if rows:
            yield _batch(rows, FETCHED)


def _hot_runs(batches: Iterable[pa.RecordBatch], length: int, unit: int) -> Iterator[pa.RecordBatch]:
    """Of hot sections (first, text, wanted): runs of the wanted windows, one at each unit, as _cut_out has them of stretches."""
    schema = pa.schema([PIECES.field(n) for n in ("block", "text", "grams", "wholes", "at", "windows")])
    for batch in batches:
        firsts = batch.column(0).to_pylist()
        ends, of = ragged(batch.column(2))
        rows: list[tuple] = []
        for i in range(batch.num_rows):
            text, own = batch.column(1)[i].as_py(), np.arange(ends[i], ends[i + 1])
            place = of["window_at"][own] - firsts[i]
            for run in runs_of(of["role"][own], of["block"][own], place, place + unit - 1):
                a, z = int(place[run[0]]), int(place[run[-1]])
                asked = run if of["role"][own[run[0]]] == 1 else run[:0]
                rows.append((int(of["block"][own[run[0]]]), text[a : z + length], of["gram"][own[asked]], of["whole"][own[asked]], place[asked] - a, np.ones(asked.size, np.int64)))
            if len(rows) > 1 << 12:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)


def _frequent(batches: Iterable[pa.RecordBatch], grams: np.ndarray, wholes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of stretches (uid, id, gram, whole, place): those of known texts as runs of windows; neighbours in a document become one."""
    mask = (1 << SPAN_BITS) - 1
    most = int(np.unique(wholes, return_counts=True)[1].max())
    for batch in batches:
        uid, id_, gram, whole, place = (batch.column(k).to_numpy() for k in range(5))
        at = np.searchsorted(wholes, whole)
        sure = np.zeros(whole.size, bool)
        for k in range(most):  # 1, unless two grams have texts of one hash
            near = np.minimum(at + k, wholes.size - 1)
            sure |= (wholes[near] == whole) & (grams[near] == gram)
        uid, id_, first = uid[sure], id_[sure], place[sure] >> 2 * SPAN_BITS
        last = first + ((place[sure] >> SPAN_BITS) & mask)
        if not uid.size:
            continue
        opens = np.concatenate([[True], (uid[1:] != uid[:-1]) | (id_[1:] != id_[:-1]) | (first[1:] != last[:-1] + 1)])
        closes = np.concatenate([opens[1:], [True]])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uid[opens], id_[opens], first[opens], last[closes])], names=["uid", "id", "first", "last"])


def _together(rows: pa.Table, key: str, shard_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """Slices of rows (sorted by key) of whole keys, of about shard_bytes of text, and where each begins."""
    keys, sizes = rows.column(key).to_numpy(), pa.compute.binary_length(rows.column("text")).to_numpy()
    at, held = 0, 0
    for end in np.flatnonzero(np.concatenate([keys[1:] != keys[:-1], [True]])).tolist() if keys.size else ():
        held = int(sizes[at : end + 1].sum())
        if held >= shard_bytes or end + 1 == keys.size:
            yield at, rows.slice(at, end + 1 - at)
            at = end + 1


def _decided(rows: pa.Table, length: int) -> list[np.ndarray]:
    """For each row's text, which of its windows occur again in these rows."""
    texts = [t.as_buffer() for chunk in rows.column("text").chunks for t in chunk]
    return repeated_windows(texts, [len(t) - length + 1 for t in texts], length)


def _shard(rows: pa.Table, length: int, shard_bytes: int) -> pa.Table:
    """Of texts (uid, id, gram, first, text): runs of windows that occur again under their gram."""
    rows = rows.sort_by([("gram", "ascending"), ("uid", "ascending"), ("first", "ascending")])
    uids, ids, firsts = (rows.column(c).to_numpy() for c in ("uid", "id", "first"))
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
    for at, part in _together(rows, "gram", shard_bytes):
        for k, marks in enumerate(_decided(part, length), at):
            a, b = runs(marks)
            for column, x in zip(out, (np.full(a.size, uids[k]), np.full(a.size, ids[k]), a + firsts[k], b + firsts[k]), strict=True):
                column.append(x)
    give_back()
    return pa.table({n: np.concatenate(c) for n, c in zip(("uid", "id", "first", "last"), out, strict=True)})


def _shard_of_runs(rows: pa.Table, length: int, shard_bytes: int) -> pa.Table:
    """Of runs: gram and hash of the stretches of which all windows occur again in their block."""
    rows = rows.sort_by("block")
    out: list[list[int]] = [[], []]
    for _, part in _together(rows, "block", shard_bytes):
        asked = zip(*(part.column(n).to_pylist() for n in ("grams", "wholes", "at", "windows")), strict=True)
        for marks, of in zip(_decided(part, length), asked, strict=True):
            for gram, whole, at, n in zip(*of, strict=True):
                if marks[at : at + n].all():
                    out[0].append(gram)
                    out[1].append(whole)
    give_back()
    return pa.table({"gram": pa.array(out[0], pa.int64()), "whole": pa.array(out[1], pa.int64())})


def _sharded(rows: DataFrame, key: str, work, schema: str, length: int, shard_bytes: int) -> DataFrame:
    """Stored rows with texts, dealt by key to shards of about shard_bytes, each given to work."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    return rows.withColumn("shard", F.pmod(F.xxhash64(key, F.lit(3)), F.lit(shards))).groupBy("shard").applyInArrow(lambda t: work(t, length, shard_bytes), schema)


def _reps(classes: DataFrame, block: Column) -> Column:
    """Two occurrences (one, two) of each class (gram, whole), to be compared in a block; an array of structs."""
    at = lambda name, role: F.struct(F.col(f"{name}.uid").alias("uid"), F.col(f"{name}.id").alias("id"), F.struct(F.lit(role).cast("long").alias("role"), "gram", "whole", F.col(f"{name}.place").alias("place"), block.alias("block")).alias("w"))
    return F.array(at("one", 1), at("two", 2))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_sections: int = MOST_SECTIONS, shard_bytes: int = SHARD_BYTES, unit: int = 1) -> DataFrame:
    """docs: uid, id (long), data (binary); no two texts share both numbers. Returns uid, id, first, last: runs of windows that occur again.

    With a unit over 1 only windows that begin at a multiple of it are asked for; others may or may not be among the runs.
    """
    if not (SECTION <= length < 1 << SPAN_BITS and 1 <= gram <= length):
        raise ValueError(f"length {length} and gram {gram} are out of range")
    docs = docs.select("uid", "id", "data")
    rows = stored(docs.mapInArrow(lean(lambda b: _rows(b, length, gram)), "uid long, id long, gram long, whole long, place long"), "stretches")
    # By gram and text of the stretch, formed before any join: how often, and its first and last place.
    place = F.struct("uid", "id", "place")
    whole = stored(rows.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(place).alias("one"), F.max(place).alias("two")), "texts")
    grams = whole.groupBy("gram").agg(F.count("*").alias("texts"), F.min("n").alias("least"))
    open_grams = stored(grams.where("texts > 1 AND least = 1").select("gram"), "grams")
    # Texts that occur once, of grams with several texts, with the other texts of such grams: role 0. Of texts that occur again
    # the first and the last: roles 1 and 2. All of a document go together.
    single = whole.join(open_grams, "gram").select(F.col("one.uid").alias("uid"), F.col("one.id").alias("id"), F.struct(F.lit(0).cast("long").alias("role"), "gram", "whole", F.col("one.place").alias("place"), F.lit(0).cast("long").alias("block")).alias("w"))
    again = whole.where("n > 1")
    block = F.xxhash64("one.uid", "one.id", F.shiftright("one.place", 2 * SPAN_BITS + BLOCK_BITS))
    pairs = again.select(F.inline(_reps(again, block)))
    wanted = stored(single.unionByName(pairs).groupBy("uid", "id").agg(F.collect_list("w").alias("wanted")), "wanted")
    sought = in_doubt_of(docs, wanted.select("uid"), "uid").where("_in_doubt").join(wanted, ["uid", "id"])
    pieces = stored(sought.select("uid", "id", "data", "wanted").mapInArrow(lean(lambda b: _cut_out(b, length)), PIECES_SQL), "pieces")
    runs_ = pieces.where("block IS NOT NULL").select("block", "text", "grams", "wholes", "at", "windows")
    sure = stored(_sharded(runs_, "block", _shard_of_runs, "gram long, whole long", length, shard_bytes), "sure")
    # At most MOST_FREQUENT texts are that frequent: they are broadcast, so that a very common passage is marked without a shuffle.
    bound = max(FREQUENT, rows.count() // MOST_FREQUENT)
    common = sure.join(again.where(F.col("n") > bound), ["gram", "whole"]).select("gram", "whole").toArrow().sort_by("whole")
    known = docs.sparkSession.sparkContext.broadcast((common.column(0).to_numpy(), common.column(1).to_numpy()))
    first = F.shiftright("place", 2 * SPAN_BITS)
    last = first + F.shiftright("place", SPAN_BITS).bitwiseAND(F.lit((1 << SPAN_BITS) - 1))
    rest = sure.join(again.where(F.col("n") <= bound).select("gram", "whole"), ["gram", "whole"])
    marks = rows.join(rest, ["gram", "whole"]).select("uid", "id", first.alias("first"), last.alias("last"))
    if common.num_rows:
        marks = marks.unionByName(rows.select("uid", "id", "gram", "whole", "place").mapInArrow(lambda b: _frequent(b, *known.value), "uid long, id long, first long, last long"))
    parts = pieces.where("core IS NOT NULL")
    cores = stored(parts.groupBy("gram", "core").agg(F.count("*").alias("n")).where("n > 1").select("gram", "core"), "cores")
    live = stored(parts.select("uid", "id", "gram", "stretch", "core", "first", "last").join(cores, ["gram", "core"]), "live")
    hot = stored(live.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > most_sections).select("gram", F.lit(1).alias("hot")), "hot")
    asked = live.join(hot, "gram", "left").select("uid", "id", "gram", "stretch", F.struct("core", "first", "last", F.coalesce("hot", F.lit(0)).cast("long").alias("hot")).alias("w"))
    asked = asked.groupBy("uid", "id", "gram", "stretch").agg(F.collect_list("w").alias("wanted"))
    held = parts.where("text IS NOT NULL").select("uid", "id", "gram", "stretch", "text").join(asked, ["uid", "id", "gram", "stretch"])
    fetched = stored(held.select("uid", "id", "gram", "stretch", "text", "wanted").mapInArrow(lean(lambda b: _fetch(b, length, unit)), FETCHED_SQL), "fetched")
    cold = fetched.where("core IS NULL").select("uid", "id", "gram", "first", "text")
    marks = marks.unionByName(_sharded(cold, "gram", _shard, "uid long, id long, first long, last long", length, shard_bytes))
    # Hot grams: windows of equal hash, two of each, are compared like stretches.
    windows = stored(fetched.where("core IS NOT NULL").select("uid", "id", "gram", "first", F.posexplode("windows").alias("at", "whole")).withColumn("place", (F.ceil(F.col("first") / unit) + F.col("at")) * unit), "windows")
    if not windows.isEmpty():
        place = F.struct("uid", "id", "first", "place")
        twice = stored(windows.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(place).alias("one"), F.max(place).alias("two")).where("n > 1"), "twice")
        pairs = twice.select(F.inline(_reps(twice, F.xxhash64("gram", "one.uid", "one.id", "one.first"))), "one", "two")
        section = F.when(F.col("w.role") == 1, F.col("one.first")).otherwise(F.col("two.first")).alias("first")
        pairs = pairs.select("uid", "id", F.col("w.gram").alias("gram"), section, F.struct("w.role", "w.gram", "w.whole", F.col("w.place").alias("window_at"), "w.block").alias("w"))
        pairs = pairs.groupBy("uid", "id", "gram", "first").agg(F.collect_list("w").alias("wanted"))
        runs_ = fetched.where("core IS NOT NULL").select("uid", "id", "gram", "first", "text").join(pairs, ["uid", "id", "gram", "first"])
        runs_ = stored(runs_.select("first", "text", "wanted").mapInArrow(lambda b: _hot_runs(b, length, unit), RUNS_SQL), "hot_runs")
        found = stored(_sharded(runs_, "block", _shard_of_runs, "gram long, whole long", length, shard_bytes), "found")
        marks = marks.unionByName(windows.join(found, ["gram", "whole"]).select("uid", "id", F.col("place").alias("first"), F.col("place").alias("last")))
    marks = stored(marks.groupBy("uid", "id").agg(F.collect_list(F.struct("first", "last")).alias("marks")), "marks")
    forget(rows, open_grams, whole, wanted, pieces, sure, cores, live, hot, fetched, windows)
    return marks


def covered(first: np.ndarray, last: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Bytes of runs of windows as disjoint spans: starts and ends."""
    if not first.size:
        return [], []
    order = np.argsort(first, kind="stable")
    first, ends = first[order], np.maximum.accumulate(last[order]) + length
    opens = np.flatnonzero(np.concatenate([[True], first[1:] > ends[:-1]]))
    return first[opens].tolist(), ends[np.concatenate([opens[1:] - 1, [first.size - 1]])].tolist()


def edges_of_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text begins and ends."""
    raw = np.frombuffer(data, np.uint8)
    return runs((raw != 32) & ((raw < 9) | (raw > 13)))


def _coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the hashes of their words in place of the bytes."""
    digest = xxhash.xxh64_digest
    for batch in batches:
        data = [b"".join([digest(w)[:CODE] for w in text.as_py().split()]) for text in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(data, pa.binary())], names=["uid", "id", "data"])


def _of_few_words(batches: Iterable[pa.RecordBatch], length: int, words: int) -> Iterator[pa.RecordBatch]:
    """Parts of texts of which no window may hold so many whole words, each as a text (part and number of its first byte)."""
    names = ["uid", "id", "data", "of_uid", "of_id"]
    for batch in batches:
        rows: list[tuple] = []
        for uid, id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = text.as_py()
            if len(data) < length:
                continue
            first, last = edges_of_words(data)
            marks = np.zeros(len(data) + 1, np.int32)
            marks[first + 1] = 1
            begun = np.cumsum(marks)  # words that begin before each byte
            inside = begun[length:] - begun[: len(data) - length + 1]
            cut = np.zeros(len(data) - length + 1, bool)  # windows whose first byte is within a word; that word is cut
            marks[:] = 0
            marks[first + 1] += 1
            marks[last + 1] -= 1
            cut |= np.cumsum(marks)[: cut.size] > 0
            a, b = runs(inside + cut < words + 2)
            for x, z in zip(a.tolist(), b.tolist(), strict=True):
                key = xxhash.xxh64_intdigest(b"%d %d %d" % (uid, id_, x))
                rows.append((key - (key >> 63 << 64), x, data[x : z + length], uid, id_))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def passages(docs: DataFrame, words: int, length: int = LENGTH, **options) -> DataFrame:
    """As repeats, of passages of so many words: marks of runs of words (word 1) and, where words are few, of strings of length bytes (word 0)."""
    coded = docs.select("uid", "id", "data").mapInArrow(lean(_coded), "uid long, id long, data binary")
    in_words = repeats(coded, **options | {"length": words * CODE, "gram": min(GRAM_WORDS, words) * CODE, "unit": CODE})
    run = F.struct(F.ceil(F.col("m.first") / CODE).cast("long").alias("first"), F.floor(F.col("m.last") / CODE).cast("long").alias("last"), F.lit(1).cast("long").alias("word"))
    in_words = in_words.select("uid", "id", F.explode("marks").alias("m")).select("uid", "id", run.alias("m")).where("m.first <= m.last")
    few = stored(docs.select("uid", "id", "data").mapInArrow(lean(lambda b: _of_few_words(b, length, words)), "uid long, id long, data binary, of_uid long, of_id long"), "few")
    in_bytes = repeats(few, length, **options)
    whose = few.select("uid", "id", "of_uid", "of_id").distinct()
    run = F.struct((F.col("m.first") + F.col("id")).alias("first"), (F.col("m.last") + F.col("id")).alias("last"), F.lit(0).cast("long").alias("word"))
    in_bytes = in_bytes.join(whose, ["uid", "id"]).select("of_uid", "of_id", "id", F.explode("marks").alias("m")).select(F.col("of_uid").alias("uid"), F.col("of_id").alias("id"), run.alias("m"))
    marks = stored(in_words.unionByName(in_bytes).groupBy("uid", "id").agg(F.collect_list("m").alias("marks")), "marks")
    forget(few)
    return marks


def _spans(column: pa.ListArray, length: int, texts: pa.Array, words: int | None = None) -> Iterator[tuple[list[int], list[int]]]:
    ends, of = ragged(column)
    for a, b, text in zip(ends, ends[1:], texts, strict=False):
        first, last = of["first"][a:b], of["last"][a:b]
        if words and b > a and of["word"][a:b].any():  # runs of words, from the first one's first byte to the last one's last
            begins, closes = edges_of_words(text.as_buffer())
            by = of["word"][a:b] == 1
            first, last = first.copy(), last.copy()
            first[by], last[by] = begins[first[by]], closes[last[by] + words - 1] + 1 - length
        yield covered(first, last, length)


def with_marks(docs: DataFrame, words: int | None = None, **options) -> DataFrame:
    """docs with _data (the text as bytes) and _marks (runs of repeated windows, or null; with words those of passages)."""
    given = docs.withColumn("_data", F.coalesce(F.col("text").cast("binary"), F.lit(b""))).withColumn("_uid", F.xxhash64("doc_id", "text")).withColumn("_id", F.coalesce("doc_id", F.lit(0)).cast("long"))
    own = given.select(F.col("_uid").alias("uid"), F.col("_id").alias("id"), F.col("_data").alias("data"))
    marks = passages(own, words, **options) if words else repeats(own, **options)
    # Texts that surely have no marks pass without a shuffle.
    doubtful = in_doubt_of(given, marks.select("uid"))
    sure = doubtful.where("NOT _in_doubt").withColumn("_marks", F.lit(None).cast(marks.schema["marks"].dataType))
    left = doubtful.where("_in_doubt").join(marks.select(F.col("uid").alias("_uid"), F.col("id").alias("_id"), F.col("marks").alias("_marks")), ["_uid", "_id"], "left")
    return sure.unionByName(left).select(*docs.columns, "_data", "_marks")


def removals(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, (starts, ends) in zip(batch.column(1), _spans(batch.column(2), length, batch.column(1)), strict=True):
                data = text.as_buffer()
                kept, at = hashlib.sha256(), 0
                for a, b in zip(starts, ends, strict=True):
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                rows.append((len(data), sum(ends) - sum(starts), len(starts), kept.hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 3, pa.string()), strict=True))], names=names)

    marked = with_marks(docs.select("doc_id", "text"), length=length, **options)
    return marked.select("doc_id", "_data", "_marks").mapInArrow(lean(digested), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut(docs: DataFrame, length: int = LENGTH, words: int | None = None, **options) -> DataFrame:
    """docs without the repeated strings; a character of which a byte goes, goes. n_chars, if there, is counted anew.

    With words, what goes are passages of so many words, and strings of length bytes in which words are fewer.
    """
    docs, given_names = renamed(docs, *[n for n in ("doc_id", "text", "n_chars") if n in docs.columns])
    names = docs.columns
    kinds = {"text": pa.string(), "n_chars": pa.int64()}

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, (starts, ends) in zip(batch.column(batch.num_columns - 2), _spans(batch.column(batch.num_columns - 1), length, batch.column(batch.num_columns - 2), words), strict=True):
                data, parts, at = text.as_py(), [], 0
                for a, b in zip(starts, ends, strict=True):
                    parts.append(data[at:a].decode("utf-8", "ignore"))
                    at = b
                parts.append(data[at:].decode("utf-8", "ignore"))
                out.append("".join(parts))
            made = {"text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())}
            given = iter(batch.columns)
            yield pa.RecordBatch.from_arrays([made[n] if n in kinds else next(given) for n in names], names=names)

    schema = StructType([StructField(f.name, LongType() if f.name == "n_chars" else f.dataType) for f in docs.schema.fields])
    marked = with_marks(docs, words, length=length, **options)
    return marked.select(*[n for n in names if n not in kinds], "_data", "_marks").mapInArrow(lean(kept), schema).toDF(*given_names)
