"""Quality of documents by Bradley-Terry pairwise ranking.

A document's strength is linear in figures of its text: shares of characters, words and lines of several
kinds, repetition, and lengths. Preference pairs put a document labelled 1 before one labelled 0; the weights
minimise the logistic loss on the differences of their figures (Newton steps, ridge penalty). A quantile of the
strengths of the training documents is the threshold: the one with the best balanced accuracy. The score is the
logistic function of the distance from it, so 0.5 marks the threshold.

Fitting takes at most `sample` labelled documents (a documented bound, chosen by a hash of the id); their
figures, a few hundred bytes each, come to the driver. Scoring reads whole texts, in one pass without shuffle.

Defined results: null and empty texts get the figures of an empty text; with no labels of both kinds every
score is 0.5; repeated rows get the same score; an empty table gives no rows; columns other than those named
are ignored, and labels, lang, source and id are never figures. A document with several labels counts for each.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

SAMPLE, PAIRS, RIDGE, STEPS = 8_000, 40_000, 1e-3, 12
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASSES = np.zeros((256, 6))
for _b in range(256):
    _c = bytes([_b])
    _CLASSES[_b] = [_c.isupper(), _c.islower(), _c.isdigit(), _c.isspace(), _b >= 128, _c in _SIGNS]
_UPPER, _LOWER, _SIGN = (_CLASSES[:, k].astype(np.uint8) for k in (0, 1, 5))
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?:\"")] = True
_RUN = re.compile(rb"[!-/:-@\[-`{-~]{2,}")


def figures(text: str | None) -> np.ndarray:
    """What the strength is linear in."""
    data = (text or "").encode("utf-8", "replace")
    n = len(data) + 1
    at = np.frombuffer(data, np.uint8)
    counts = np.bincount(at, minlength=256)
    classes = counts @ _CLASSES / n
    signs = counts[list(_SIGNS)] / n
    words = data.split()
    w = len(words) + 1
    low = data.lower().split()
    runs = _RUN.findall(data)
    # By line: shares tell a document with a few bad lines from one that is slightly odd throughout.
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = len(lines) + 1
    odd = loud = short = ended = 0.0
    lengths = np.zeros(1)
    if lines:
        joined = np.frombuffer(b"\n".join(lines), np.uint8)
        lengths = np.fromiter(map(len, lines), np.float64, len(lines))
        starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)]).astype(np.int64)
        upper, lower, sign = (np.add.reduceat(k[joined], starts, dtype=np.int64) for k in (_UPPER, _LOWER, _SIGN))
        odd = float((sign * 10 > lengths).sum()) / m
        loud = float(((upper > lower) & (lengths > 8)).sum()) / m
        short = float((lengths < 30).mean())
        ended = float(_ENDS[joined[(starts + lengths - 1).astype(np.int64)]].mean())
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    again = sum(map(operator.eq, low, low[1:])) / w
    shares = np.concatenate([classes, signs, [len(runs) / w, sum(map(len, runs)) / n, odd, loud, again]])
    return np.concatenate(
        [
            shares,
            np.log1p(200 * shares),
            [short, ended, len(set(lines)) / m, 1 - len(lines) / m, len(set(low)) / (w**0.8), np.log(n), np.log(w), np.log(m), sizes.mean(), sizes.std(), np.log1p(sizes.max()), np.log1p(lengths.mean()), np.log1p(lengths.std()), classes[5] ** 2, odd * odd, loud * loud],
        ]
    )


class Model:
    """Standardised weights and the map from strength to score."""

    def __init__(self, mean, scale, weights, threshold=0.0, unit=1.0):
        self.mean, self.scale, self.weights, self.threshold, self.unit = mean, scale, weights, threshold, unit

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.strength(x) - self.threshold) / self.unit, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 1) -> Model:
    """Bradley-Terry on rows of figures x with labels y (0 or 1)."""
    dims = x.shape[1] if x.ndim == 2 else figures("").size
    if not (0 < y.sum() < y.size):
        return Model(np.zeros(dims), np.ones(dims), np.zeros(dims))
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-9, np.zeros(dims))
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    rnd = np.random.default_rng(seed)
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = max(pairs, 1)
    # Every document takes part: each side is dealt in turn, in random order.
    first, second = (np.concatenate([rnd.permutation(side) for _ in range(-(-n // side.size))])[:n] for side in (better, worse))
    d = z[first] - z[second]
    w = model.weights
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))  # of the wrong order
        gradient = -(d * p[:, None]).mean(axis=0) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(dims)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    model.weights = w
    s = z @ w
    steps = np.unique(s)
    cuts = (steps[1:] + steps[:-1]) / 2 if steps.size > 1 else steps  # all quantiles: one between any two strengths
    up, down = np.sort(s[y == 1]), np.sort(s[y == 0])
    balanced = 1 - np.searchsorted(up, cuts) / up.size + np.searchsorted(down, cuts) / down.size
    best = cuts[balanced >= balanced.max() - 1e-9]
    model.threshold = float(best[0] + (best[-1] - best[0]) / 3)  # in a gap, nearer to the rejected
    model.unit = float(max(s.std() / 4, 1e-6))
    return model


def gather(docs: DataFrame, labels: DataFrame, label: str, trains: Column, of: Callable, schema: str, sample: int) -> pa.Table:
    """What `of` makes of a bounded number of labelled documents, with their labels (column y), on the driver.

    Half of each class; ids are chosen by a hash, so that the choice does not depend on the order of rows; the list of ids is
    at most `sample` long, and so is what is broadcast. Where rows repeat their ids, the first 2 * sample rows by id and what
    `of` makes of them (column x) are taken.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & trains).select("doc_id", F.col(label).cast("int").alias("y"))
    first = [F.xxhash64("doc_id", F.lit(5)), F.col("doc_id")]
    known = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(*first).limit(sample // 2).collect()]  # top-k: bounded by sample
    if not known:
        return pa.table({"y": pa.array([], pa.int32())})
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in known], "doc_id long, y int")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").mapInArrow(lean(of), schema).orderBy("doc_id", "y", "x").limit(2 * sample).toArrow()


def _sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [figures(t.as_py()).astype(np.float32).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], names=["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, trains: Column, label: str = "quality", sample: int = SAMPLE) -> Model:
    """trains: which rows of labels may be learnt from."""
    rows = gather(docs, labels, label, trains, _sampled, "doc_id long, y int, x binary", sample)
    if not rows.num_rows:
        return fit(np.zeros((0, figures("").size)), np.zeros(0))
    rows = rows.take(pa.compute.sort_indices(rows, [("doc_id", "ascending"), ("y", "ascending")]))
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(rows.num_rows, -1).astype(np.float64)
    return fit(x, rows.column("y").to_numpy())


def with_scores(docs: DataFrame, model, figures_of: Callable = figures) -> DataFrame:
    """doc_id, score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.score(np.stack([figures_of(t.as_py()) for t in batch.column(1).slice(at, 256)])) for at in range(0, batch.num_rows, 256)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lean(scored), "doc_id long, score double")


def only_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows of docs with a score of at least that, all columns; one pass, no shuffle."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def good(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(place)
                keep = np.concatenate([shared.value.score(np.stack([figures(t.as_py()) for t in texts.slice(at, 256)])) for at in range(0, batch.num_rows, 256)]) >= least
                yield batch.filter(pa.array(keep))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(lean(good), docs.schema)
