"""Declared collections: vector fields, validation, compatibility of schemas, fingerprints."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.vectors import check_metric

INDEXES = ("flat", "hnsw", "ivf", "ivfpq", "int8", "f16", "binary", "pq")
CODECS = ("none", "int8", "f16", "binary", "pq")


@dataclass(frozen=True)
class VectorField:
    name: str
    dim: int
    metric: str = "cosine"
    index: str = "flat"
    model: str = ""
    query_encoder: str = ""
    permission: str = ""
    #: Codes that are written beside sealed segments.
    codec: str = "none"

    def __post_init__(self):
        check_metric(self.metric)
        if self.dim <= 0:
            raise ValueError(f"field {self.name!r} needs a positive width")
        if self.index not in INDEXES:
            raise ValueError(f"index is one of {INDEXES}, not {self.index!r}")
        if self.codec not in CODECS:
            raise ValueError(f"codec is one of {CODECS}, not {self.codec!r}")


@dataclass(frozen=True)
class Collection:
    name: str
    fields: tuple[VectorField, ...] = field(default=())

    def __post_init__(self):
        seen = [f.name for f in self.fields]
        if len(set(seen)) < len(seen):
            raise ValueError("a field is declared twice")

    def get(self, name: str) -> VectorField:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(f"{self.name} has no field {name!r}")

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "fields": [asdict(f) for f in self.fields]}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Collection:
        d = json.loads(text)
        return cls(d["name"], tuple(VectorField(**f) for f in d["fields"]))

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()


def fingerprint(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def short_fingerprint(data: Column) -> Column:
    return F.substring(fingerprint(data), 1, 12)


def redacted(name: str, protection: str, dim: int | None = None) -> str:
    """What logs may say: never components, and no name from a vault."""
    shown = "vault" if protection in ("vault", "sealed") else name
    return shown if dim is None else f"{shown}[{dim}]"


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """point_type, field, change for each difference of two schema tables (point_type, field, dim, metric, model).

    change: removed, dim, metric, model (breaking) or added (additive). Models that are not set are not compared.
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, (F.col("o.point_type") == F.col("n.point_type")) & (F.col("o.field") == F.col("n.field")), "full")
    missing, extra = F.col("n.field").isNull(), F.col("o.field").isNull()
    changes = F.filter(
        F.array(
            F.when(missing, "removed"),
            F.when(extra, "added"),
            F.when(~missing & ~extra & (F.col("o.dim") != F.col("n.dim")), "dim"),
            F.when(~missing & ~extra & (F.col("o.metric") != F.col("n.metric")), "metric"),
            F.when(~missing & ~extra & (F.col("o.model") != "") & (F.col("n.model") != "") & (F.col("o.model") != F.col("n.model")), "model"),
        ),
        lambda x: x.isNotNull(),
    )
    return both.select(F.coalesce("o.point_type", "n.point_type").alias("point_type"), F.coalesce("o.field", "n.field").alias("field"), F.explode(changes).alias("change"))


def verdict(changes: DataFrame) -> str:
    kinds = {r[0] for r in changes.select("change").distinct().collect()}
    return "identical" if not kinds else "additive" if kinds == {"added"} else "breaking"
