"""Scoring texts with a small causal self-attention model on subword ids, joined with corpus word counts.

A text is its words in ASCII lower case, then one end. Each word is spelt in subwords (byte-level BPE, the word
with a space before it, so that the spelling can be undone). Texts are spelt once: ids of subwords and hashes of words
are stored, and counting pairs, learning and scoring read those. A word begins where a subword begins with a space.

Counts. The occurrences of every word of every training document are counted: in tasks first, then by a
shuffle of words. Words are told apart by their hash (64 bits; two of 500 million words share one with probability 0.007).
Words of at least `frequent` of all tokens, at most 1/frequent of them, are broadcast; the others meet their counts in a join.

Attention model. One causal self-attention layer in numpy: subwords are read through tables of query, key and
value, scores get a bias by distance, and the sum over the values moves the logits that the last subword
gives. Outputs are classes of subwords (the most frequent have one each) with subword shares within a
class. Contexts are windows of 32 subwords that overlap by half; in each the second half is scored, so that
each subword is scored once, with 16 to 31 before it, in batches with a causal mask.

It learns from all training texts. What follows what is counted in all of them: that gives its inputs, its
classes, the shares within a class and where the table of the last subword begins. Its parameters are first fitted on
the driver on `sample` pieces (texts are cut into pieces of `PIECE_CHARS`, chosen by a hash), which is only where they
start from: each task then goes on from there through every window of its texts, and the mean of what the tasks
learnt, weighted by their windows, is the model. A corpus of fewer than twice `sample` pieces is fitted on the driver,
on all of its pieces. Which texts a task reads depends on the partitions of the table; reruns on the same agree.

A word is scored by its count within the class of its first subword, and that class by the attention model:
with A the model's probability of the class given that a word starts, K the class's share of all counts and p the
model's probability of the word's whole spelling (including that the word then ends, so that it sums to one over
words), the probability is

    (1 - MIX) * (k * (CONTEXT * A / K + 1 - CONTEXT) + discount * V / N * p) + MIX * p,  k = max(c - discount, 0) / N,

where discount is the part of words that occur once, so that as much is left for new words as the words seen once
take (Good and Turing). K is summed over all training words, so that the probabilities of all words sum to one
in every context. The score is the sum of log10 over words and end.

Defined results: null and empty texts are the end alone; repeated rows are scored each for itself; without
training tokens N and V are 0, base_score is 0 per token and score is the attention model's, untrained; an empty
table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import base64
import copy
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, lean, stored

HALF, DIM, CLASSES, INPUTS = 16, 16, 128, 1024
SAMPLE, PIECE_CHARS, EPOCHS, BATCH = 3000, 2000, 2, 256
FREQUENT, MIX, CONTEXT, ADD = 2.5e-7, 0.4, 0.95, 0.1
CACHE_WORDS, COUNTED_WORDS = 300_000, 1 << 20
#: Rate of learning in tasks; pairs counted together, and numbers of a parameter that are averaged together.
RATE, COUNTED_PAIRS, CHUNK = 0.003, 1 << 20, 1 << 13
#: Bounds of parameters: scores stay within 16 * 4 + 6, logits within 20 + 16 * 2.
LIMITS = {"q": 2.0, "k": 2.0, "v": 2.0, "far": 6.0, "out": 1.0, "last": 20.0}
#: Words scored together, and windows.
WORDS_AT_ONCE, WINDOWS = 50_000, 32
#: Places whose logits are held at a time while learning.
PLACES = 384
#: Of the scored places in a window from all places in it.
DISTANCE = np.arange(HALF - 1, 2 * HALF - 1)[:, None] - np.arange(2 * HALF)[None, :]
END = b""


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def signed(hashes: list[int] | np.ndarray) -> np.ndarray:
    return np.array(hashes, np.uint64).view(np.int64)


def words_of(text: str | None) -> list[bytes]:
    out = (text or "").encode("utf-8", "replace").lower().split()
    out.append(END)
    return out


class Numbers(dict):
    """Of each key a number, in the order in which they are first looked up."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


class Speller:
    """Subword ids of words, as ragged arrays; remembers a bounded number of words."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32  # of ids as they are stored
        self.starts = np.zeros(self.size, bool)
        for token, i in ranks.items():
            self.starts[i] = token[:1] == b" "
        self.starts[self.end] = True
        self.encode = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.reset()

    def reset(self) -> None:
        self.index = Numbers()
        self.hashes, self.begin, self.length, self.ids = (np.zeros(1 << 12, t) for t in (np.int64, np.int64, np.int32, np.int32))
        self.used = 0

    def spell(self, word: bytes) -> list[int]:
        return self.encode(" " + word.decode("utf-8")) if word else [self.end]

    def of(self, words: list[bytes]) -> np.ndarray:
        """An index for each word, into hashes, begin and length (of ids)."""
        if len(self.index) > CACHE_WORDS:
            self.reset()
        at = len(self.index)
        found = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        new = list(islice(reversed(self.index), len(self.index) - at))[::-1]
        if new:
            spelt = [self.spell(w) for w in new]
            sizes = np.fromiter(map(len, spelt), np.int64, len(new))
            total = int(sizes.sum())
            for name, need in (("hashes", at + len(new)), ("begin", at + len(new)), ("length", at + len(new)), ("ids", self.used + total)):
                if getattr(self, name).size < need:
                    setattr(self, name, np.concatenate([getattr(self, name), np.zeros(need, getattr(self, name).dtype)]))
            self.hashes[at : at + len(new)] = signed([word_hash(w) for w in new])
            self.length[at : at + len(new)] = sizes
            self.begin[at : at + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(spelt), np.int32, total)
            self.used += total
        return found

    def flat(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the indexed words in a row, and where each word begins."""
        n = self.length[at].astype(np.int64)
        first = np.cumsum(n) - n
        return self.ids[np.repeat(self.begin[at] - first, n) + np.arange(int(n.sum()))], first


_spellers: dict[str, Speller] = {}


def speller(path: str) -> Speller:
    if path not in _spellers:
        _spellers[path] = Speller(path)
    return _spellers[path]


def lay_out(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Texts of so many ids on one tape: each begins after HALF blanks and ends at a multiple of HALF.

    Returns the place of each id, the windows (by their first block) that score ids, and the length.
    """
    blocks = 1 + -(-sizes // HALF)
    at = (np.cumsum(blocks) - blocks) * HALF
    total = int(blocks.sum()) * HALF
    first = np.cumsum(sizes) - sizes
    places = np.repeat(at + HALF - first, sizes) + np.arange(int(sizes.sum()))
    blank = np.zeros(total // HALF, bool)
    blank[at // HALF] = True
    return places, np.flatnonzero(~blank) - 1, total


#: exp(x) in single precision by the exponent's bits is quick_exp(EXP_UNIT * x + EXP_ZERO).
EXP_UNIT, EXP_ZERO = np.float32((1 << 23) / np.log(2)), np.float32((127 << 23) - 366_393)


def quick_exp(x: np.ndarray) -> np.ndarray:
    """Exponential, linear between powers of two (within 3 %), of x in units of EXP_UNIT from EXP_ZERO.

    What is formed of it is divided by its own sum, so that probabilities still sum to one. |exponents| < 80.
    """
    return x.astype(np.int32).view(np.float32)


class InOrder:
    """Rows of a table as they are read: their order by how often a row is read, then the row; the rows in that order and where each begins.

    Runs of one length are neighbours, so that wide ones are summed as one array.
    """

    def __init__(self, rows: np.ndarray):
        order = np.argsort(rows.astype(np.int16) if rows.max() < 1 << 15 else rows, kind="stable")  # a radix sort, of 16 bits
        keys = rows[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        length = np.diff(np.append(first, keys.size))
        by = np.argsort(length, kind="stable")
        self.length = length[by]
        self.first = np.cumsum(self.length) - self.length
        self.runs = keys[first[by]]
        self.keys = np.repeat(self.runs, self.length)
        self.order = order[np.repeat(first[by] - self.first, self.length) + np.arange(keys.size)]
        self.cuts = np.concatenate([[0], np.flatnonzero(np.diff(self.length)) + 1, [self.length.size]])

    def sums(self, parts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Sums of parts, in this order, by the row of the table that they belong to."""
        out = np.zeros((table.shape[0], parts.shape[1]), table.dtype)
        out[self.runs] = np.add.reduceat(parts, self.first, axis=0)
        return out

    def blocks(self, n: int) -> Iterator[tuple[int, int, list[tuple[int, int, int, int]]]]:
        """Places in this order in blocks of about n, each of whole runs: begin and end, and of each length of runs there the first run, the end, where they begin and the length."""
        ends = np.unique(np.append(np.searchsorted(self.first, np.arange(n, self.keys.size, n)), self.length.size))
        begin = 0
        for end in ends.tolist():
            edges = [begin, *self.cuts[(self.cuts > begin) & (self.cuts < end)].tolist(), end]
            runs = [(a, b, int(self.first[a]), int(self.length[a])) for a, b in zip(edges, edges[1:], strict=False)]
            yield runs[0][2], runs[-1][2] + (runs[-1][1] - runs[-1][0]) * runs[-1][3], runs
            begin = end


class Attention:
    """The model's tables and parameters."""

    def __init__(self, sizes: tuple[int, int], starts: np.ndarray, seed: int = 1):
        """sizes: of inputs and classes; starts: which subwords begin a word. All subwords in two classes until fitted."""
        rnd = np.random.default_rng(seed)
        inputs, classes = sizes
        f = np.float32
        self.q, self.k, self.v = (rnd.normal(0, 0.3, (inputs, DIM)).astype(f) for _ in range(3))
        self.far = np.zeros(2 * HALF, f)
        self.out = rnd.normal(0, 0.05, (DIM, classes)).astype(f)
        self.last = np.zeros((inputs, classes), f)
        self.input_of = np.where(starts, 1, 2).astype(np.int64)
        self.class_of = np.where(starts, 0, 1).astype(np.int64)
        self.opening = 1  # classes of subwords that begin a word come first
        share = np.array([starts.sum(), (~starts).sum()], float)
        self.within = (-np.log(share)[self.class_of]).astype(f)

    def names(self) -> tuple[str, ...]:
        return ("q", "k", "v", "far", "out", "last")

    def moments(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        return {n: (np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))) for n in self.names()}

    def update(self, grads: dict[str, np.ndarray], moments: dict[str, tuple[np.ndarray, np.ndarray]], done: int, rate: float) -> None:
        """Adam's step number `done`; the table of the last subword moves at half the rate."""
        for name, g in grads.items():  # which are overwritten
            m, v = moments[name]
            own = rate if name != "last" else rate / 2
            table = getattr(self, name)
            m *= 0.9
            m += 0.1 * g
            g *= g
            g *= 0.01
            v *= 0.99
            v += g
            np.sqrt(v, out=g)
            g /= (1 - 0.99**done) ** 0.5
            g += 1e-8
            np.divide(m, g, out=g)
            g *= own / (1 - 0.9**done)
            table -= g
            np.clip(table, -LIMITS[name], LIMITS[name], out=table)

    def _distances(self) -> np.ndarray:
        """Bias by distance; what comes after the asking place is masked."""
        return np.where(DISTANCE >= 0, self.far[np.maximum(DISTANCE, 0)], np.float32(-1e9)).astype(np.float32)

    def step(self, window: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean loss on classes target of the scored places, weight 0 for blanks. window: inputs, (n, 2 * HALF).

        Scored is what follows places HALF - 1 to 2 * HALF - 2. Places go in an order in which those that read
        the same row are neighbours, so that rows of the tables are summed in runs. LIMITS keep exponents in range without shifting them first.
        """
        n = window.shape[0]
        asks = window[:, HALF - 1 : 2 * HALF - 1]
        asked, read = InOrder(asks.ravel()), InOrder(window.ravel())
        q, k, v = self.q.take(asks, axis=0), self.k.take(window, axis=0), self.v.take(window, axis=0)
        p = q @ k.transpose(0, 2, 1)
        p += self._distances()
        np.exp(p, out=p)
        p /= (p @ np.ones(2 * HALF, p.dtype))[:, :, None]
        mean = (p @ v).reshape(n * HALF, DIM).take(asked.order, axis=0)
        weight = (weight / max(weight.sum(), 1))[asked.order]
        target = target[asked.order]
        # Logits are as wide as the classes; what is made of a block of them stays in a core's cache.
        back = np.ascontiguousarray(self.out.T)
        ones, places = np.ones(back.shape[0], back.dtype), np.arange(n * HALF)
        g = {"out": np.zeros_like(self.out), "last": np.zeros_like(self.last)}
        slope = np.empty_like(mean)
        for begin, end, runs in asked.blocks(PLACES):
            logits = mean[begin:end] @ self.out
            logits += self.last.take(asked.keys[begin:end], axis=0)
            np.exp(logits, out=logits)
            sums = logits @ ones
            logits[places[: end - begin], target[begin:end]] -= sums
            scale = weight[begin:end] / sums
            g["out"] += (mean[begin:end] * scale[:, None]).T @ logits
            np.multiply(logits @ back, scale[:, None], out=slope[begin:end])
            for a, b, at, length in runs:
                own = slice(at - begin, at - begin + (b - a) * length)
                g["last"][asked.runs[a:b]] = (scale[own].reshape(b - a, 1, length) @ logits[own].reshape(b - a, length, -1))[:, 0]
        dm, level = np.empty_like(mean), np.empty_like(weight, slope.dtype)
        dm[asked.order] = slope
        # The mean of a place's slopes by p is the product of its mean and that mean's slope.
        level[asked.order] = np.einsum("ij,ij->i", slope, mean)
        dm = dm.reshape(n, HALF, DIM)
        ds = dm @ v.transpose(0, 2, 1)
        ds -= level.reshape(n, HALF, 1)
        ds *= p
        both = np.empty((n, 2 * HALF, 2 * DIM), p.dtype)
        np.matmul(p.transpose(0, 2, 1), dm, out=both[:, :, :DIM])
        np.matmul(ds.transpose(0, 2, 1), q, out=both[:, :, DIM:])
        both = read.sums(both.reshape(-1, 2 * DIM).take(read.order, axis=0), self.v)
        g["v"], g["k"] = both[:, :DIM].copy(), both[:, DIM:].copy()
        g["q"] = asked.sums((ds @ k).reshape(-1, DIM).take(asked.order, axis=0), self.q)
        # What comes after the asking place has p 0.
        g["far"] = np.bincount(np.maximum(DISTANCE, 0).ravel(), np.ones(n, ds.dtype) @ ds.reshape(n, -1), 2 * HALF).astype(np.float32)
        return g

    def log_probabilities(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ids of texts of such sizes: log p of each id, and of any id there that begins a word."""
        places, windows, total = lay_out(sizes)
        tape = np.zeros(total, np.int64)
        tape[places] = self.input_of[ids]
        target = np.zeros(total, np.int64)
        target[places] = self.class_of[ids]
        lp, ls = np.zeros(total, np.float32), np.zeros(total, np.float32)
        span = np.arange(2 * HALF)
        bias = self._distances()
        seen = (bias > -1e8).astype(np.float32)
        bias = bias * seen * EXP_UNIT + EXP_ZERO
        query, out, last = self.q * EXP_UNIT, self.out * EXP_UNIT, self.last * EXP_UNIT + EXP_ZERO
        # LIMITS keep exponents in range without shifting them first; a sum comes with the product.
        values = np.concatenate([self.v, np.ones((self.v.shape[0], 1), np.float32)], axis=1)
        kinds = np.zeros((last.shape[1], 2), np.float32)
        kinds[: self.opening, 0] = kinds[self.opening :, 1] = 1
        for at in range(0, windows.size, WINDOWS):
            here = windows[at : at + WINDOWS, None] * HALF + span
            window = tape[here]
            asks = window[:, HALF - 1 : 2 * HALF - 1]
            heat = query.take(asks, axis=0) @ self.k.take(window, axis=0).transpose(0, 2, 1)
            heat += bias
            heat = quick_exp(heat)
            heat *= seen
            mean = (heat @ values.take(window, axis=0)).reshape(-1, DIM + 1)
            logits = (mean[:, :DIM] / mean[:, DIM:]) @ out
            logits += last.take(asks.ravel(), axis=0)
            logits = quick_exp(logits)
            sums = logits @ kinds
            scored = here[:, HALF:].ravel()
            whole = np.log(sums.sum(axis=1))
            lp[scored] = np.log(logits[np.arange(scored.size), target[scored]]) - whole
            ls[scored] = np.log(sums[:, 0]) - whole
        return lp[places].astype(np.float64) + self.within[ids], ls[places].astype(np.float64)

    def word_log10(self, ids: np.ndarray, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word log10 p of its spelling, and log10 p of its first subword's class, given that a word starts.

        ids: of all words; first: where each word begins; words: how many are in each text (the last is the end).
        """
        per_word = np.diff(np.concatenate([first, [ids.size]]))
        ends = np.cumsum(words)
        sizes = np.add.reduceat(per_word, ends - words)
        lp, ls = self.log_probabilities(ids, sizes)
        own = np.add.reduceat(lp, first) - ls[first]
        opens = lp[first] - self.within[ids[first]] - ls[first]
        closes = np.ones(first.size, bool)
        closes[ends - 1] = False
        at = np.flatnonzero(closes)
        own[at] += ls[first[at + 1]]
        return own / np.log(10), opens / np.log(10)


def _groups(rows: np.ndarray, n: int, rnd: np.random.Generator) -> np.ndarray:
    """k-means of rows into n groups at most."""
    if rows.shape[0] <= n:
        return np.arange(rows.shape[0])
    centre = rows[rnd.choice(rows.shape[0], n, replace=False)]
    for _ in range(8):
        near = np.argmin((centre * centre).sum(axis=1)[None] - 2 * rows @ centre.T, axis=1)
        for c in range(n):
            if (near == c).any():
                centre[c] = rows[near == c].mean(axis=0)
    return near


class Follow:
    """What follows what in a whole corpus, from a stored table: before (a subword, or -1 for none), after, c."""

    def __init__(self, pairs: DataFrame, size: int):
        self.pairs, self.size = pairs, size

    def counts(self) -> np.ndarray:
        found = self.pairs.groupBy("after").agg(F.sum("c").alias("c")).toArrow()  # a row for each subword
        out = np.zeros(self.size, np.int64)
        out[found.column("after").to_numpy()] = found.column("c").to_numpy()
        return out

    def before(self, slot: np.ndarray) -> np.ndarray:
        """Of each subword, how often it follows each slot."""
        out = np.zeros((self.size, int(slot.max()) + 1), np.float32)
        (x, y), c = self._summed(slot, np.arange(self.size))
        out[y, x] = c
        return out

    def classes(self, input_of: np.ndarray, class_of: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        out = np.zeros(shape, np.float64)
        at, c = self._summed(input_of, class_of)
        out[at] = c
        return out

    def _summed(self, first: np.ndarray, second: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        known = self.pairs.sparkSession.sparkContext.broadcast((first, second))

        def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, second = known.value
            for batch in batches:
                before = batch.column(0).to_numpy()
                x = np.where(before < 0, 0, first[before])  # input and slot 0: nothing before
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)), pa.array(second[batch.column(1).to_numpy()].astype(np.int64)), batch.column(2)], names=["x", "y", "c"])

        found = self.pairs.mapInArrow(lean(mapped), "x long, y long, c long").groupBy("x", "y").agg(F.sum("c").alias("c")).toArrow()
        x, y, c = (found.column(n).to_numpy() for n in ("x", "y", "c"))
        return (x, y), c


def fit(texts: list[str], path: str, classes: int = CLASSES, inputs: int = INPUTS, epochs: int = EPOCHS, seed: int = 1, follow: Follow | None = None) -> Attention:
    """Fit on texts; each ends with the end. With follow, counts are those of a whole corpus and texts are where parameters start."""
    spell = speller(path)
    rnd = np.random.default_rng(seed)
    words = [words_of(t) for t in texts]
    if not words:
        return Attention((3, 2), spell.starts)
    at = spell.of([w for ws in words for w in ws])
    ids, first = spell.flat(at)
    counts = follow.counts() if follow else np.bincount(ids, minlength=spell.size)
    seen = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
    sizes = np.add.reduceat(np.diff(np.concatenate([first, [ids.size]])), np.cumsum([0, *map(len, words[:-1])]))

    model = Attention((inputs, classes), spell.starts, seed)
    model.input_of = np.where(spell.starts, 1, 2).astype(np.int64)  # 0: blank
    model.input_of[seen[: inputs - 3]] = 3 + np.arange(min(seen.size, inputs - 3))
    # Classes: one for each of the most frequent; the rest by the classes that come before them.
    single = seen[: classes * 3 // 4]
    rest = seen[single.size :]
    slot = np.zeros(spell.size, np.int64)
    slot[single] = 1 + np.arange(single.size)
    before = follow.before(slot) if follow else np.zeros((spell.size if rest.size else 1, single.size + 1), np.float32)
    if rest.size and not follow:
        np.add.at(before, (ids[1:], slot[ids[:-1]]), 1)
    groups: list[np.ndarray] = []
    left = classes - single.size
    opening, inner = rest[spell.starts[rest]], rest[~spell.starts[rest]]
    share = max(1, min(left - 1, round(left * counts[opening].sum() / max(1, counts[rest].sum()))))
    for own, n in ((opening, share), (inner, left - share)):
        if own.size:
            rows = np.sqrt(before[own] / before[own].sum(axis=1, keepdims=True).clip(1))
            near = _groups(rows, n, rnd)
            groups += [own[near == c] for c in np.unique(near)]
    members = sorted([np.array([i]) for i in single] + groups, key=lambda g: not spell.starts[g[0]])
    unseen = np.flatnonzero(counts == 0)
    kinds = [bool(spell.starts[g[0]]) for g in members]
    for begins in (True, False):  # unseen subwords join a class of their kind
        if begins not in kinds:
            members.insert(0 if begins else len(members), np.zeros(0, np.int64))
            kinds.insert(0 if begins else len(kinds), begins)
        k = len(kinds) - 1 - kinds[::-1].index(begins)
        members[k] = np.concatenate([members[k], unseen[spell.starts[unseen] == begins]])
    classes = len(members)
    model.opening = sum(kinds)
    model.class_of = np.zeros(spell.size, np.int64)
    for c, own in enumerate(members):
        model.class_of[own] = c
    smooth = counts + np.where(counts > 0, 0.0, 0.05)
    sums = np.bincount(model.class_of, smooth, classes)
    model.within = np.log(smooth / sums[model.class_of]).astype(np.float32)
    model.out = rnd.normal(0, 0.05, (DIM, classes)).astype(np.float32)

    places, windows, total = lay_out(sizes)
    tape, target, weight = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.float32)
    tape[places], target[places], weight[places] = model.input_of[ids], model.class_of[ids], 1
    if follow:
        pairs = follow.classes(model.input_of, model.class_of, (inputs, classes))
        share = pairs.sum(axis=0) + 0.1
    else:
        share = np.bincount(target[places], minlength=classes) + 0.1
        pairs = np.zeros((inputs, classes), np.float64)
        np.add.at(pairs, (tape[places - 1], target[places]), 1)
    model.last = np.log((pairs + 8 * share / share.sum()) / (pairs.sum(axis=1, keepdims=True) + 8)).astype(np.float32)
    moments = model.moments()
    steps = epochs * -(-windows.size // BATCH)
    done = 0
    for _ in range(epochs):
        order = rnd.permutation(windows)
        for b in range(0, order.size, BATCH):
            here = order[b : b + BATCH, None] * HALF + np.arange(2 * HALF)
            scored = here[:, HALF:].ravel()
            grads = model.step(tape[here], target[scored], weight[scored])
            done += 1
            model.update(grads, moments, done, 0.02 * (1 - done / (steps + 1)))
    return model


def _follow(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Of texts: how often a subword comes after another, or after none."""
    spell = speller(path)
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        both, c = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(both // spell.size - 1), pa.array(both % spell.size), pa.array(c)], names=["before", "after", "c"])

    for flat, sizes, _ in _spelt(batches, spell):
        before = np.concatenate([[0], flat[:-1].astype(np.int64) + 1])
        before[np.cumsum(sizes) - sizes] = 0
        held.append(before * spell.size + flat)
        if sum(h.size for h in held) > COUNTED_PAIRS:
            yield out()
    if held:
        yield out()
    spell.reset()


def _binary(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Numbers of texts as bytes of each; ends: of each text's."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * numbers.itemsize
    return pa.Array.from_buffers(pa.large_binary(), ends.size, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(numbers))]).cast(pa.binary())


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts from the bytes of each (not null), and where each text's begin (and the last one's end)."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    numbers = np.frombuffer(column.buffers()[2], kind, int(at[-1] - at[0]) // size, int(at[0]))
    return numbers, (at - at[0]) // size


def _together(words: np.ndarray) -> Iterator[tuple[int, int]]:
    """Texts of so many words in groups of about WORDS_AT_ONCE words: first text and the end."""
    cuts = np.flatnonzero(np.diff(np.cumsum(words) // WORDS_AT_ONCE)) + 1
    edges = [0, *cuts.tolist(), words.size]
    yield from zip(edges, edges[1:], strict=False)


def _spell(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Of texts (text, then other columns): ids of the subwords and hashes of the words of each, as bytes, then those columns."""
    spell = speller(path)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            words: list[bytes] = []
            sizes: list[int] = []
            begin = at
            while at < batch.num_rows and len(words) < WORDS_AT_ONCE:
                own = words_of(batch.column(0)[at].as_py())
                words += own
                sizes.append(len(own))
                at += 1
            index = spell.of(words)
            flat, first = spell.flat(index)
            ends = np.cumsum(sizes)
            columns = [_binary(flat.astype(spell.kind), np.append(first, flat.size)[ends]), _binary(spell.hashes[index], ends)]
            yield pa.RecordBatch.from_arrays([*columns, *(c.slice(begin, at - begin) for c in batch.columns[1:])], names=["ids", "words", *batch.schema.names[1:]])
    spell.reset()


def _spelt(batches: Iterable[pa.RecordBatch], spell: Speller) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of texts (the first column: texts, or ids as _spell has them), many texts at a time, how many ids each has, and how many words."""
    words: list[bytes] = []
    counts: list[int] = []

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, first = spell.flat(spell.of(words))
        of_text = np.array(counts)
        sizes = np.add.reduceat(np.diff(np.concatenate([first, [flat.size]])), np.cumsum(of_text) - of_text)
        words.clear()
        counts.clear()
        return flat, sizes, of_text

    for batch in batches:
        if pa.types.is_binary(batch.schema.types[0]):
            if batch.num_rows:
                ids, at = _numbers(batch.column(0), spell.kind)
                of_text = np.add.reduceat(spell.starts[ids], at[:-1], dtype=np.int64)
                for a, b in _together(of_text):
                    yield ids[at[a] : at[b]], np.diff(at[a : b + 1]), of_text[a:b]
            continue
        for text in batch.column(0):
            own = words_of(text.as_py())
            words.extend(own)
            counts.append(len(own))
            if len(words) > WORDS_AT_ONCE:
                yield out()
    if words:
        yield out()


def _learn(batches: Iterable[pa.RecordBatch], path: str, start: Attention) -> Iterator[pa.RecordBatch]:
    """Go on from start through all windows of a task's texts, each once; chunks of the parameters, and the number of windows."""
    model, spell, part = copy.deepcopy(start), speller(path), TaskContext.get().partitionId()
    moments, rnd, done, seen = model.moments(), np.random.default_rng(part), 0, 0
    for ids, sizes, _ in _spelt(batches, spell):
        places, windows, total = lay_out(sizes)
        tape, target, weight = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.float32)
        tape[places], target[places], weight[places] = model.input_of[ids], model.class_of[ids], 1
        order = rnd.permutation(windows)
        for b in range(0, order.size, BATCH):
            here = order[b : b + BATCH, None] * HALF + np.arange(2 * HALF)
            scored = here[:, HALF:].ravel()
            done += 1
            # The last steps of a block may hold few windows; their rate is less.
            model.update(model.step(tape[here], target[scored], weight[scored]), moments, done, RATE * len(here) / BATCH)
        seen += windows.size
    spell.reset()
    if seen:
        numbers = np.concatenate([getattr(model, n).ravel() for n in model.names()])
        chunks = [numbers[at : at + CHUNK].tobytes() for at in range(0, numbers.size, CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(chunks)), pa.array(range(len(chunks))), pa.array([seen] * len(chunks)), pa.array(chunks, pa.binary())], names=["part", "chunk", "windows", "numbers"])


def _mean(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("part")  # sums in one order
    windows = rows.column("windows").to_numpy()
    mean = sum(w * np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for w, x in zip(windows, (x for c in rows.column("numbers").chunks for x in c), strict=True)) / windows.sum()
    return pa.table({"chunk": rows.column("chunk")[:1], "windows": pa.array([int(windows.sum())]), "numbers": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def learn(texts: DataFrame, pieces: list[str], path: str) -> Attention:
    """The model of all texts (text, or ids if they are spelt); pieces of them are where its parameters start."""
    context = texts.sparkSession.sparkContext
    texts = texts.select("ids" if "ids" in texts.columns else "text")
    pairs = texts.mapInArrow(lean(lambda batches: _follow(batches, path)), "before long, after long, c long")
    pairs = stored(pairs.groupBy("before", "after").agg(F.sum("c").alias("c")), "follow")
    model = fit(pieces, path, follow=Follow(pairs, speller(path).size))
    start = context.broadcast(model)
    each = texts.mapInArrow(lean(lambda batches: _learn(batches, path, start.value)), "part long, chunk long, windows long, numbers binary")
    mean = stored(each.groupBy("chunk").applyInArrow(_mean, "chunk long, windows long, numbers binary"), "learnt").orderBy("chunk").collect()
    numbers = np.frombuffer(b"".join(r["numbers"] for r in mean), np.float32)
    at = 0
    for name in model.names():
        table = getattr(model, name)
        setattr(model, name, numbers[at : at + table.size].reshape(table.shape).copy())
        at += table.size
    return model


def _count(batches: Iterable[pa.RecordBatch], path: str, class_of: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of spelt texts (ids, words): words by hash, occurrences, and the class of their first subword; of a bounded number of tokens at a time."""
    spell = speller(path)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        words, classes = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(words)
        words = words[order]
        first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(words[first]), pa.array(np.diff(np.append(first, words.size))), pa.array(classes[order[first]])], names=["word", "c", "class"])

    for batch in batches:
        if not batch.num_rows:
            continue
        (ids, ids_at), (words, words_at) = _numbers(batch.column(0), spell.kind), _numbers(batch.column(1), np.int64)
        for begin, end in _together(np.diff(words_at)):
            own = ids[ids_at[begin] : ids_at[end]]
            held.append((words[words_at[begin] : words_at[end]].copy(), class_of[own[spell.starts[own]]].astype(np.int32)))
            if sum(w.size for w, _ in held) > COUNTED_WORDS:
                yield out()
    if held:
        yield out()


def count_words(spelt: DataFrame, path: str, class_of) -> DataFrame:
    """word (hash), c: occurrences of each word, and of the end, in spelt texts; class: of its first subword. class_of: a broadcast."""
    counted = spelt.select("ids", "words").mapInArrow(lean(lambda batches: _count(batches, path, class_of.value)), "word long, c long, class int")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.min("class").alias("class"))


def _pieces() -> Column:
    return F.floor((F.length("text") + (PIECE_CHARS - 1)) / PIECE_CHARS).cast("int")


def count_pieces(texts: DataFrame) -> int:
    return texts.agg(F.coalesce(F.sum(_pieces()), F.lit(0))).first()[0]


def pieces_of(texts: DataFrame, sample: int, total: int | None = None) -> list[str]:
    """About `sample` different pieces of the texts (text, not null), at most twice as many; chosen by a hash of the piece and its place."""
    count = _pieces()
    total = count_pieces(texts) if total is None else total
    own = texts.where("text <> ''").withColumn("h", F.xxhash64("text"))
    chosen = F.filter(F.sequence(F.lit(0), count - 1), lambda k: F.pmod(F.xxhash64("h", k), F.lit(max(1, total // sample))) == 0)
    each = own.select(F.explode(F.transform(chosen, lambda k: F.substring(F.col("text"), k * PIECE_CHARS + 1, F.lit(PIECE_CHARS)))).alias("piece"))
    return [r[0] for r in each.distinct().orderBy(F.xxhash64("piece"), "piece").limit(2 * sample).collect()]


PASSED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, rare_p array<float>, rare_r array<float>"


def score(docs: DataFrame, held_out: Column, path: str, sample: int = SAMPLE, frequent: float = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    path: of a byte-level BPE vocabulary in rank form. Rows for which held_out holds are not learnt from.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    train, context = docs.where(~F.col("held_out")), docs.sparkSession.sparkContext
    texts = train.where(F.col("text").isNotNull())
    total = count_pieces(texts)
    pieces = pieces_of(texts, sample, total)
    learnt = F.coalesce(~F.col("held_out"), F.lit(False)).alias("learnt")
    spelt = stored(docs.select("text", "doc_id", "held_out", learnt).mapInArrow(lean(lambda batches: _spell(batches, path)), "ids binary, words binary, doc_id long, held_out boolean, learnt boolean"), "spelt")
    model = learn(spelt.where("learnt"), pieces, path) if total >= 2 * sample else fit(pieces, path)
    counts = stored(count_words(spelt.where("learnt"), path, context.broadcast(model.class_of)), "counts")
    n, v, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first()
    discount = min(0.9, max(0.1, once / max(1, v)))
    # Of each class, at most CLASSES of them: its share of all discounted counts.
    shares = np.zeros(int(model.class_of.max()) + 1)
    for r in counts.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        shares[r["class"]] = (r["c"] - discount * r["n"]) / max(n - discount * v, 1e-9)
    # Words with at least that share of all tokens: at most 1 / frequent.
    common = counts.where(F.col("c") >= F.lit(max(1.0, frequent * n))).select("word", "c").toArrow().sort_by("word")
    shared = context.broadcast((model, shares, common.column("word").to_numpy(), common.column("c").to_numpy()))
    low = float(n + ADD * (v + 1)) or 1.0

    def known(c: np.ndarray, p: np.ndarray, r: np.ndarray) -> np.ndarray:
        """log10 of the joined probability of words with c occurrences, log10 p by spelling, and A / K of the class."""
        spelt = np.exp(np.maximum(p, -300) * np.log(10))
        return np.log10((1 - MIX) * (np.maximum(c - discount, 0) / n * (CONTEXT * r + (1 - CONTEXT)) + discount * v / n * spelt) + MIX * spelt)

    def passed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shares, top, top_c = shared.value
        with np.errstate(divide="ignore"):
            inverse = np.where(shares > 0, 1 / shares, 0.0)
        spell = speller(path)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            if not batch.num_rows:
                continue
            (ids, ids_at), (all_hashes, words_at) = _numbers(batch.column(0), spell.kind), _numbers(batch.column(1), np.int64)
            for begin, end in _together(np.diff(words_at)):
                flat, hashes, size = ids[ids_at[begin] : ids_at[end]], all_hashes[words_at[begin] : words_at[end]], np.diff(words_at[begin : end + 1])
                first = np.flatnonzero(spell.starts[flat])
                p, opens = model.word_log10(flat, first, size)
                r = np.exp(opens * np.log(10)) * inverse[model.class_of[flat[first]]]
                found, order = np.empty(hashes.size, np.int64), np.argsort(hashes)
                found[order] = np.searchsorted(top, hashes[order])  # faster by far in order
                found[found == top.size] = 0
                is_top = top[found] == hashes if top.size else np.zeros(hashes.size, bool)
                starts = np.cumsum(size) - size
                c = top_c[found].astype(np.float64) if top.size else np.zeros(hashes.size)
                score_ = np.where(is_top, known(c, p, r), 0.0) if n else p
                base = np.where(is_top, np.log10((c + ADD) / low), 0.0) if n else np.zeros(hashes.size)
                rare = ~is_top if n else np.zeros(hashes.size, bool)
                cut = np.concatenate([[0], np.cumsum(np.add.reduceat(rare, starts, dtype=np.int64))]).astype(np.int32)
                k = size.size
                lists = (hashes[rare], p[rare].astype(np.float32), r[rare].astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + k)),
                        batch.column(2).slice(begin, k),
                        batch.column(3).slice(begin, k),
                        pa.array(size),
                        pa.array(np.add.reduceat(is_top, starts, dtype=np.int64)),
                        pa.array(np.add.reduceat(base, starts)),
                        pa.array(np.add.reduceat(score_, starts)),
                        *(pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in lists),
                    ],
                    names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "rare_p", "rare_r"],
                )
                row += k

    rows = stored(spelt.select("ids", "words", "doc_id", "held_out").mapInArrow(lean(passed), PASSED), "scored")
    forget(spelt)
    if not n:
        return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(0).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
    each = rows.select("uid", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("rare_p").alias("p"), F.col("rare_r").alias("r"))))
    met = each.join(counts.where(F.col("c") < F.lit(max(1.0, frequent * n))).select("word", "c"), "word", "left")
    c, p, r = F.coalesce(F.col("c"), F.lit(0)).cast("double"), F.greatest(F.col("p").cast("double"), F.lit(-300.0)), F.col("r").cast("double")
    spelt = F.pow(F.lit(10.0), p)
    joined = F.log10((1 - MIX) * (F.greatest(c - discount, F.lit(0.0)) / n * (CONTEXT * r + (1 - CONTEXT)) + discount * v / n * spelt) + MIX * spelt)
    sums = met.groupBy("uid").agg(F.sum(F.log10((c + ADD) / low)).alias("more_base"), F.sum(joined).alias("more"), F.count("c").alias("more_known"))
    whole = rows.drop("rare", "rare_p", "rare_r").join(sums, "uid", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias
    return whole.select("doc_id", "held_out", "n_tokens", plus("n_known", "more_known")("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base", "more_base")("base_score"), plus("score", "more")("score"))
