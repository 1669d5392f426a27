"""The calls of a client: collections of points with named vector or text fields."""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import names as N
from orrery.sources import files, ingest, tenancy
from orrery.sources.schema import Collection as Declared
from orrery.sources.schema import VectorField
from orrery.sources.store import Store

DEFAULT_K, MOST_K = 10, 1000
_TENANT = "name string, display_name string, created_at timestamp, updated_at timestamp, deleted_at timestamp, expires_at timestamp"
_POINT = "name string, span struct<start_ms:bigint,end_ms:bigint>, content_ref struct<uri:string,range_start:bigint,range_end:bigint,sha256:binary,inline_text:string>, vectors map<string,array<float>>"


@dataclass
class Hits:
    """A search's answer."""

    frame: DataFrame
    #: Whether all spaces could be searched, and those that could not.
    is_complete: bool = True
    locked_spaces: list[str] = field(default_factory=list)
    #: Where the next page begins; empty after the last.
    next_page_token: str = ""
    #: Rows that could have been found, by where they lie.
    stats: dict[str, int] = field(default_factory=dict)

    def rows(self) -> list:
        return self.frame.orderBy("rank").collect()

    def __len__(self) -> int:
        return self.frame.count()


class BatchError(ValueError):
    """A batch that was refused: where in it, and how much was written (nothing: a batch is whole or not at all)."""

    def __init__(self, index: int, written: int, why: str):
        super().__init__(f"point {index} of the batch: {why}; {written} written")
        self.index, self.written = index, written


class NewCollection:
    """Declares fields, then creates."""

    def __init__(self, client: Client, name: str):
        self._client, self._name, self._fields = client, name, []

    def field(self, name: str, dim: int, metric: str = "cosine", index: str = "flat", codec: str = "none") -> NewCollection:
        self._fields.append(VectorField(name, dim, metric, index, codec=codec))
        return self

    def text_field(self, name: str, dim: int = 64) -> NewCollection:
        self._fields.append(VectorField(name, dim, "cosine", "flat", model="hashed-words", query_encoder="hashed-words"))
        return self

    def create(self) -> Collection:
        if not self._fields:
            raise ValueError("a collection needs a field")
        self._client.store.create(Declared(self._name, tuple(self._fields)))
        return self._client.collection(self._name)


def _skip(page_token: str) -> int:
    if not page_token:
        return 0
    found = re.fullmatch(rb"skip=(\d+)", base64.urlsafe_b64decode(page_token.encode()))
    if not found:
        raise ValueError("not a page token of ours")
    return int(found[1])


class Collection:
    def __init__(self, client: Client, name: str):
        self._store, self._spark, self.name = client.store, client.spark, name
        self.declared = self._store.get(name)
        if self.declared is None:
            raise KeyError(name)

    def _full(self, point: str) -> str:
        return f"{self.name}/points/{point}"

    def insert(self, point: str, **vectors: list[float]) -> bool:
        """False if the point exists."""
        return self.insert_many([(point, vectors)]) == 1

    def insert_many(self, points: list[tuple[str, dict[str, list[float]]]]) -> int:
        if not points:
            raise ValueError("an empty batch")
        kind = "index int, " + _POINT
        rows = [(i, self._full(p), None, None, {k: [float(x) for x in v] for k, v in vs.items()}) for i, (p, vs) in enumerate(points)]
        frame = self._spark.createDataFrame(rows, kind)
        bad = self._store.checked(self.name, frame).where("fault IS NOT NULL").orderBy("index").select("index", "fault").first()
        if bad:
            raise BatchError(bad["index"], 0, bad["fault"])
        return self.insert_frame(frame.drop("index"))

    def insert_with_text(self, point: str, text: str, span: tuple[int, int] | None = None, **vectors: list[float]) -> bool:
        """A point with its text beside vectors of the caller; False if it exists."""
        ref = (None, None, None, hashlib.sha256(text.encode()).digest(), text)
        return self.insert_frame(self._spark.createDataFrame([(self._full(point), span, ref, {k: [float(x) for x in v] for k, v in vectors.items()})], _POINT)) == 1

    def insert_frame(self, points: DataFrame) -> int:
        """name (whole), span, content_ref, vectors."""
        return self._store.append(self.name, points)

    def add_texts(self, texts: DataFrame, field: str) -> int:
        """texts: id, text."""
        spec = self.declared.get(field)
        embedded = ingest.embed(texts.select("id", "text"), dim=spec.dim)
        ref = F.struct(F.lit(None).cast("string").alias("uri"), F.lit(None).cast("bigint").alias("range_start"), F.lit(None).cast("bigint").alias("range_end"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha256"), F.col("text").alias("inline_text"))
        span = F.lit(None).cast("struct<start_ms:bigint,end_ms:bigint>")
        return self.insert_frame(embedded.select(F.concat(F.lit(f"{self.name}/points/"), F.col("id")).alias("name"), span.alias("span"), ref.alias("content_ref"), F.create_map(F.lit(field), F.col("vec")).alias("vectors")))

    def add_text(self, point: str, text: str, field: str) -> bool:
        return self.add_texts(self._spark.createDataFrame([(point, text)], "id string, text string"), field) == 1

    def get(self, point: str):
        """The point, or None."""
        return self._store.point(self.name, self._full(point)).first()

    def list(self) -> DataFrame:
        return self._store.points(self.name).where(N.is_child(F.col("name"), self.name, "points")).orderBy("name")

    def delete(self, *points: str) -> None:
        self._store.delete(self.name, [self._full(p) for p in points])

    def search(self, field: str, query: list[float], k: int = DEFAULT_K, allowed: DataFrame | None = None, mask: str = "", page_token: str = "", spaces: DataFrame | None = None) -> Hits:
        """One page of at most k (1000 at most) answers. spaces (name, protection): what the caller may search, for the answer's coverage."""
        k, skip = min(k, MOST_K), _skip(page_token)
        found = files.kept(self._store.search(self.name, field, query, k + 1, allowed, mask, skip), "page")
        rows = found.count()
        stats = {r["source"]: r["n"] for r in self._store.vectors(self.name, field).where("vec IS NOT NULL").groupBy("source").agg(F.count("*").alias("n")).collect()}
        seen = tenancy.coverage(spaces).first() if spaces is not None else None
        token = base64.urlsafe_b64encode(f"skip={skip + k}".encode()).decode() if rows > k else ""
        return Hits(found.where(F.col("rank") <= skip + k), seen is None or seen["complete"], [] if seen is None else list(seen["locked_spaces"]), token, stats)

    def search_text(self, field: str, text: str, k: int = DEFAULT_K) -> Hits:
        spec = self.declared.get(field)
        query = ingest.embed(self._spark.createDataFrame([(text,)], "text string"), dim=spec.dim).first()["vec"]
        return self.search(field, [float(x) for x in query], k)


class Client:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.store = spark, Store(spark, base)

    def create_collection(self, name: str) -> NewCollection:
        return NewCollection(self, name)

    def collection(self, name: str) -> Collection:
        return Collection(self, name)

    def list_collections(self) -> list[str]:
        return self.store.list()

    def delete_collection(self, name: str) -> bool:
        return self.store.drop(name)

    # Organisations, projects, spaces and sessions: a small table, rewritten whole at each change.

    def _tenancy_paths(self) -> list[int]:
        return sorted(int(n) for n in files.names(self.spark, f"{self._tenancy}") if n.isdigit())

    @property
    def _tenancy(self) -> str:
        return f"{self.store.base}.tenancy"

    def tenants(self) -> DataFrame:
        found = self._tenancy_paths()
        return self.spark.read.schema(_TENANT).parquet(f"{self._tenancy}/{found[-1]}") if found else self.spark.createDataFrame([], _TENANT)

    def _save(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self._tenancy}/{max(self._tenancy_paths(), default=0) + 1}")

    def create_tenant(self, name: str, display_name: str = "", protection: str = "none") -> None:
        self._save(tenancy.create(self.tenants(), name, display_name, F.current_timestamp(), protection))

    def list_tenants(self, parent: str, kind: str, show_deleted: bool = False) -> list[str]:
        return [r["name"] for r in tenancy.children(self.tenants(), parent, kind, show_deleted).orderBy("name").collect()]

    def delete_tenant(self, name: str) -> None:
        self._save(tenancy.soft_delete(self.tenants(), F.col("name") == name, F.current_timestamp()))

    def undelete_tenant(self, name: str) -> None:
        self._save(tenancy.undelete(self.tenants(), F.col("name") == name))


def connect(spark: SparkSession, base: str) -> Client:
    return Client(spark, base)
