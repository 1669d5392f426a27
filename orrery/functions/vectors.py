"""Vector functions as columns. All sums are formed in doubles; a pair of vectors is read up to the shorter one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("dot", "l2", "cosine")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}, not {metric!r}")
    return metric


def higher_is_nearer(metric: str) -> bool:
    return check_metric(metric) != "l2"


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _shorter(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def dot(a: Column, b: Column, same_length: bool = True) -> Column:
    a, b = (a, b) if same_length else _shorter(a, b)
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: Column, b: Column, same_length: bool = True) -> Column:
    """Squared distance."""
    a, b = (a, b) if same_length else _shorter(a, b)
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalise(a: Column) -> Column:
    """Of length one; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>"))


def score(a: Column, query: Column, metric: str) -> Column:
    """dot and cosine: the dot product (cosine fields hold unit vectors); l2: the squared distance."""
    return l2(a, query) if check_metric(metric) == "l2" else dot(a, query)


def l2_from_dot(query_norm: Column, product: Column, row_norm: Column) -> Column:
    return query_norm * query_norm - 2 * product + row_norm * row_norm


def distance(score_: Column, metric: str) -> Column:
    """Lower is nearer."""
    return -score_ if higher_is_nearer(metric) else score_


def nearest_first(score_: str, tie: str, metric: str) -> list[Column]:
    """A total order: by score in the metric's direction, then by the tie-break, ascending."""
    return [F.col(score_).desc() if higher_is_nearer(metric) else F.col(score_).asc(), F.col(tie).asc()]


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def valid(a: Column, dim: int) -> Column:
    """May be written: of that width and finite."""
    return a.isNotNull() & (F.size(a) == dim) & finite(a)


# Codecs ------------------------------------------------------------------------------------------------


def int8_scale(a: Column) -> Column:
    """struct(scale, offset): a row's range over 255 steps; a constant or non-finite row has scale 0."""
    low, high = F.array_min(a).cast("double"), F.array_max(a).cast("double")
    sound = finite(a)
    return F.struct(F.when(sound & (high > low), (high - low) / 255).otherwise(0.0).alias("scale"), F.when(sound, low).otherwise(0.0).alias("offset"))


def int8_encode(a: Column, scale: Column, offset: Column) -> Column:
    code = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") - offset) / scale + 0.5).cast("int")))
    return F.when(scale > 0, F.transform(a, code)).otherwise(F.transform(a, lambda x: F.lit(0)))


def int8_decode(codes: Column, scale: Column, offset: Column) -> Column:
    return F.transform(codes, lambda c: c * scale + offset)


def sign_bits(a: Column) -> Column:
    """A bit for each component, 1 for at least zero, in words of 63 bits."""
    bits = F.transform(a, lambda x: (x >= 0).cast("long"))
    words = F.sequence(F.lit(0), F.ceil(F.size(a) / 63).cast("int") - 1)
    return F.transform(words, lambda w: F.aggregate(F.slice(bits, w * 63 + 1, 63), F.lit(0).cast("long"), lambda s, b: s * 2 + b))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits; null if the widths differ."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return F.when(F.size(a) == F.size(b), differ)


def binary_score(a: Column, b: Column, metric: str) -> Column:
    return -hamming(a, b) if higher_is_nearer(metric) else hamming(a, b)


def encoded_bytes(codec: str, dim: int, parts: int = 8) -> int:
    sizes = {"none": 4 * dim, "f16": 2 * dim, "int8": dim + 8, "binary": -(-dim // 8), "pq": parts}
    return sizes[codec]


def over_fetch(k: int, ratio: float | None = None) -> int:
    """Candidates that a coarse scan gives to exact scoring."""
    if ratio is None:
        return max(-(-k * 4 // 1), 32, k)
    times = min(20.0, max(2.0, 0.75 * ratio))
    return max(int(-(-k * times // 1)), 8 * int(times), 32, k)


# Pooling -----------------------------------------------------------------------------------------------


def pool_mean(rows: Column) -> Column:
    """Mean of an array of vectors, component by component."""
    n = F.size(rows)
    total = F.aggregate(F.slice(rows, 2, F.greatest(n - 1, F.lit(0))), F.get(rows, F.lit(0)).cast("array<double>"), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / n)


def pool_first(rows: Column) -> Column:
    return F.get(rows, F.lit(0))


def pool_last(rows: Column) -> Column:
    return F.element_at(rows, -1)
