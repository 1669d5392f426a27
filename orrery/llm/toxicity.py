"""Toxicity by a linear classifier with a counterfactual penalty.

A text's features are the words in it and their beginnings of 3 to 8 letters (insults are often inflected or
compounded), each counted once. Of the features of the training documents those are kept that occur in
several of them and more often in one class than chance allows. Logistic regression fits their weights; where
a labelled sentence names a group of people, the term is swapped for those of other groups, and the square
of the change in the sentence's strength is added to the loss, so that the naming itself stays neutral.

Fitting takes at most `sample` labelled documents (a documented bound, half of each class, chosen by a hash
of the id); their feature hashes come to the driver. Scoring reads whole texts, in one pass without shuffle.

Defined results: null and empty texts have no features and get the score of the prior; with no labels of
both kinds every score is 0.5; repeated rows get the same score; an empty table gives no rows; columns other
than those named are ignored, and labels, lang, source and id are never features.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches
from .quality import gather

SAMPLE, LEAST_DOCUMENTS, LEAST_CHI2, MOST_FEATURES = 10_000, 4, 12.0, 20_000
RIDGE, COUNTERFACTUAL, STEPS = 1e-3, 5.0, 400
CACHE_WORDS = 300_000
#: Names of groups of people; each stands for the others in a counterfactual.
IDENTITIES = tuple(
    "women men girls boys woman man female male muslim muslims islam jew jews jewish christian christians catholic catholics hindu hindus buddhist sikh "
    "atheist black white asian asians african africans latino latina hispanic arab arabs mexican mexicans chinese indian american americans european "
    "turkish turks polish russian russians romani gypsy immigrant immigrants refugee refugees foreigner foreigners migrant migrants gay lesbian bisexual "
    "queer transgender trans straight homosexual heterosexual disabled deaf blind autistic elderly old young teenagers "
    "frauen männer juden muslime christen schwarze weiße ausländer flüchtlinge schwule lesben türken polen behinderte "
    "femmes hommes juifs musulmans chrétiens noirs blancs arabes étrangers réfugiés immigrés homosexuels lesbiennes handicapés "
    "mujeres hombres judíos musulmanes cristianos negros blancos árabes extranjeros refugiados inmigrantes homosexuales lesbianas discapacitados".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_NAMED = re.compile(r"(?<![^\W\d_])(" + "|".join(IDENTITIES) + r")(?![^\W\d_])")


def word_features(word: str) -> set[int]:
    data = word.encode("utf-8", "replace")
    found = {zlib.crc32(data, 1)}
    for k in range(3, min(8, len(word) - 1) + 1):
        found.add(zlib.crc32(word[:k].encode("utf-8", "replace"), 1 + k))
    return found


def features(text: str | None) -> set[int]:
    out: set[int] = set()
    for word in set(_WORD.findall((text or "").lower())):
        out |= word_features(word)
    return out


def swaps(text: str | None, per_sentence: int = 3) -> Iterator[tuple[set[int], set[int]]]:
    """For each different sentence that names groups, wherever it stands: the features that a swap adds and takes away."""
    for sentence in dict.fromkeys(_SENTENCE.findall((text or "").lower())):
        named = _NAMED.findall(sentence)
        if not named:
            continue
        before = features(sentence)
        for k in range(1, per_sentence + 1):
            after = features(_NAMED.sub(lambda m, k=k: IDENTITIES[(IDENTITIES.index(m[1]) + 37 * k + len(named)) % len(IDENTITIES)], sentence))
            yield after - before, before - after


class Model:
    """Weights by feature hash; score of a text."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.weights, self.bias = dict(zip(hashes.tolist(), weights.tolist(), strict=True)), bias
        self._cache: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "_cache": {}}

    def _of(self, chunk: str) -> tuple[int, ...]:
        """Features with a weight of what stands between white space; most words have none."""
        found = self._cache.get(chunk)
        if found is None:
            found = tuple(f for word in _WORD.findall(chunk) for f in word_features(word) if f in self.weights)
            if len(self._cache) >= CACHE_WORDS:
                self._cache.clear()
            self._cache[chunk] = found
        return found

    def strength(self, text: str | None) -> float:
        found = set()
        for own in map(self._of, set((text or "").lower().split())):
            if own:
                found.update(own)
        return self.bias + sum(map(self.weights.__getitem__, sorted(found)))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.strength(text), -35, 35))))


def select(rows: list[np.ndarray], y: np.ndarray, least: int = LEAST_DOCUMENTS) -> np.ndarray:
    """Feature hashes that tell the classes apart."""
    if not rows:
        return np.zeros(0, np.int64)
    n1, n = float(y.sum()), float(y.size)
    hashes, counts = np.unique(np.concatenate(rows), return_counts=True)
    hashes, counts = hashes[counts >= least], counts[counts >= least].astype(np.float64)
    positive = np.zeros(hashes.size)
    for row, label in zip(rows, y, strict=True):
        if label and hashes.size:
            at = np.searchsorted(hashes, row)
            at[at == hashes.size] = 0
            positive[at[hashes[at] == row]] += 1
    expected = counts * n1 / n
    chi2 = (positive - expected) ** 2 / np.maximum(expected * (1 - counts / n), 1e-9) * n / max(n - n1, 1)
    keep = np.flatnonzero(chi2 >= LEAST_CHI2)
    keep = keep[np.argsort(-chi2[keep], kind="stable")[:MOST_FEATURES]]
    return np.sort(hashes[keep])


def fit(rows: list[np.ndarray], y: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray]], prior: float | None = None) -> Model:
    """rows: sorted feature hashes of each document; changes: what swaps add and take away."""
    if not (0 < y.sum() < y.size):
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    hashes = select(rows, y)

    def sparse(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = [np.searchsorted(hashes, r) for r in sets]
        at = [a[(a < hashes.size)][hashes[a[a < hashes.size]] == r[a < hashes.size]] if hashes.size else a[:0] for a, r in zip(at, sets, strict=True)]
        return np.repeat(np.arange(len(sets)), [a.size for a in at]), np.concatenate(at) if at else np.zeros(0, np.int64)

    i, j = sparse(rows)
    (ai, aj), (ri, rj) = sparse([a for a, _ in changes]), sparse([r for _, r in changes])
    prior = y.mean() if prior is None else min(max(prior, 1e-4), 1 - 1e-4)
    each = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    each /= each.sum()
    w, bias = np.zeros(hashes.size), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        s = bias + np.bincount(i, w[j], y.size)
        error = each * (1 / (1 + np.exp(-np.clip(s, -35, 35))) - y)
        gradient = np.bincount(j, error[i], w.size) + RIDGE * w / y.size**0.5
        if changes:
            # bincount of nothing counts in integers
            delta = (np.bincount(ai, w[aj], len(changes)) - np.bincount(ri, w[rj], len(changes))) * (2 * COUNTERFACTUAL / len(changes))
            gradient += np.bincount(aj, delta[ai], w.size) - np.bincount(rj, delta[ri], w.size)
        g = float(error.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2, 0.9 * mb + 0.1 * g, 0.99 * vb + 0.01 * g * g
        rate, b1, b2 = 0.1 * (1 - step / (STEPS + 1)), 1 - 0.9**step, 1 - 0.99**step
        w = w - rate * (m / b1) / (np.sqrt(v / b2) + 1e-8)
        bias -= rate * (mb / b1) / (np.sqrt(vb / b2) + 1e-8)
    used = np.abs(w) > 1e-3
    return Model(hashes[used], w[used], float(bias))


def _packed(found: Iterable[int]) -> bytes:
    return np.array(sorted(found), dtype="<u4").tobytes()


def _sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() for t in batch.column(1)]
        changes = [[{"plus": _packed(a), "minus": _packed(r)} for a, r in swaps(t)] for t in texts]
        kind = pa.list_(pa.struct([("plus", pa.binary()), ("minus", pa.binary())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([_packed(features(t)) for t in texts], pa.binary()), pa.array(changes, kind)], names=["doc_id", "y", "x", "changes"])


def train(docs: DataFrame, labels: DataFrame, trains: Column, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """trains: which rows of labels may be learnt from."""
    rows = gather(docs, labels, label, trains, _sampled, "doc_id long, y int, x binary, changes array<struct<plus:binary,minus:binary>>", sample)
    if not rows.num_rows:
        return fit([], np.zeros(0), [])
    prior = labels.where(F.col(label).isin(0, 1) & trains).agg(F.avg(F.col(label).cast("double"))).first()[0]
    # Equal texts count once: what only copies share is no evidence.
    unique = {(x, y): c for x, y, c in sorted(zip(rows.column("x").to_pylist(), rows.column("y").to_pylist(), rows.column("changes").to_pylist(), strict=True), key=lambda r: r[:2])}
    of = lambda b: np.frombuffer(b, "<u4").astype(np.int64)
    return fit([of(x) for x, _ in unique], np.array([y for _, y in unique]), [(of(c["plus"]), of(c["minus"])) for cs in unique.values() for c in cs], prior)


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lean(scored), "doc_id long, score double")
