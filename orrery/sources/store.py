"""Collections on files: points, vectors in segments, tombstones, a log, and a manifest.

A write is logged whole (its rows, then a marker with their number and checksum), makes a segment of its own (the
buffer) and then a new manifest. A manifest is a numbered file with a checksum that is created once, so two
writers cannot both publish a generation, and a reader takes the newest one that is whole. What was logged but
not published, as a writer died, `recover` applies; a torn entry and all after it are dropped. Seal merges
buffer segments into one and writes codes of declared fields beside it; compact rewrites segments without deleted rows. Vectors lie in a
long table (field, row, name, vec); cosine fields are stored at unit length. Row numbers are dense for each field
and given by the one writer that publishes; they are counted by partition, so that no task sees all rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.functions.filters import masked
from orrery.operators import approximate as A
from orrery.operators import quantize as Q
from orrery.operators.flat import batch_topk, merge_sources, recall, recall_report
from orrery.operators.index import INDEXES, prefers_exact
from orrery.sources import files
from orrery.sources.schema import Collection

VECTORS = "field string, row long, name string, vec array<float>"
POINTS = "name string, span struct<start_ms:bigint,end_ms:bigint>, content_ref struct<uri:string,range_start:bigint,range_end:bigint,sha256:binary,inline_text:string>"
TOMBSTONES = "name string"
TOMBSTONE_RATIO, SMALL_ROWS, SMALL_SEGMENTS, MOST_INPUTS = 0.2, 10_000, 4, 16


def new_only(incoming: DataFrame, existing: DataFrame, key: str = "name") -> DataFrame:
    """Creates never overwrite: rows whose key exists are left out."""
    return incoming.join(existing.select(key).distinct(), key, "left_anti")


def without_deleted(rows: DataFrame, tombstones: DataFrame, key: str = "name") -> DataFrame:
    return rows.join(tombstones.select(key).distinct(), key, "left_anti")


def renumbered(rows: DataFrame, live: Column, order: list[str], by: str | None = None) -> DataFrame:
    """Live rows in input order with new dense row numbers (new_row) in each group of by; absent but live rows stay.

    Rows are sorted into ranges, which are written; a row's number is what the ranges before hold of its group, and
    its place in its own. The driver sees a count for each range and group.
    """
    keys = [*([by] if by else []), *order]
    ranges = files.kept(rows.where(live).repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    group = F.col(by) if by else F.lit(0)
    sizes = ranges.groupBy(group.alias("_group"), "_range").agg(F.count("*").alias("n")).orderBy("_group", "_range").collect()
    before, starts = {}, []
    for r in sizes:
        starts.append((r["_group"], r["_range"], before.get(r["_group"], 0)))
        before[r["_group"]] = before.get(r["_group"], 0) + r["n"]
    kind = ranges.select(group.alias("_group")).schema["_group"].dataType.simpleString()
    offsets = rows.sparkSession.createDataFrame(starts, f"_group {kind}, _range int, _before long")
    numbered = ranges.withColumn("_group", group).withColumn("_place", F.row_number().over(Window.partitionBy("_group", "_range").orderBy(*order)) - 1)
    joined = numbered.join(F.broadcast(offsets), numbered["_group"].eqNullSafe(offsets["_group"]) & (numbered["_range"] == offsets["_range"]))
    return joined.select(*[numbered[c] for c in rows.columns], (F.col("_before") + F.col("_place")).cast("long").alias("new_row"))


def compaction_plan(segments: DataFrame, ratio: float = TOMBSTONE_RATIO, small: int = SMALL_ROWS, least: int = SMALL_SEGMENTS, most: int = MOST_INPUTS) -> DataFrame:
    """segments: id, rows, deleted. id, reason, position of what to compact: many deletions first, else many small ones."""
    share = F.when(F.col("rows") > 0, F.col("deleted") / F.col("rows")).otherwise(0.0)
    worn = segments.where(share >= ratio).select("id", F.lit("tombstones").alias("reason"), F.row_number().over(Window.orderBy(share.desc(), "id")).cast("long").alias("position"))
    tiny = segments.where((F.col("rows") < small) & (share < ratio))
    enough = segments.agg(F.count_if(share >= ratio).alias("worn"), F.count_if(F.col("rows") < small).alias("tiny")).where((F.col("worn") == 0) & (F.col("tiny") >= least))
    tiny = tiny.select("id", F.lit("small").alias("reason"), F.row_number().over(Window.orderBy("rows", "id")).cast("long").alias("position"))
    return worn.unionByName(tiny.join(enough.select(), how="left_semi", on=F.lit(True))).where(F.col("position") <= most)


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    # Catalog

    def _at(self, name: str) -> str:
        return f"{self.base}/{name.replace('/', '~')}"

    def create(self, collection: Collection) -> Collection:
        files.write_text(self.spark, f"{self._at(collection.name)}/collection.json", collection.to_json())
        self._publish(collection.name, {"generation": 0, "segments": [], "points": [], "tombstones": [], "next_row": {}, "logged": 0})
        return collection

    def get(self, name: str) -> Collection | None:
        path = f"{self._at(name)}/collection.json"
        return Collection.from_json(files.read_text(self.spark, path)) if files.exists(self.spark, path) else None

    def list(self) -> list[str]:
        return [n.replace("~", "/") for n in files.names(self.spark, self.base)]

    def drop(self, name: str) -> bool:
        files.delete(self.spark, f"{self._at(name)}/collection.json")
        return files.delete(self.spark, self._at(name))

    # Manifest

    def manifest(self, name: str) -> dict:
        """The newest one whose checksum holds."""
        found = [n for n in files.names(self.spark, f"{self._at(name)}/manifest") if n.endswith(".json")]
        for n in sorted(found, key=lambda n: -int(n[:-5])):
            try:
                sealed = json.loads(files.read_text(self.spark, f"{self._at(name)}/manifest/{n}"))
                if hashlib.sha256(sealed["body"].encode()).hexdigest() == sealed["sha256"]:
                    return json.loads(sealed["body"])
            except (ValueError, KeyError, TypeError):
                continue  # torn
        raise ValueError(f"{name} has no whole manifest")

    def _publish(self, name: str, manifest: dict) -> None:
        body = json.dumps(manifest)
        files.write_text(self.spark, f"{self._at(name)}/manifest/{manifest['generation']}.json", json.dumps({"body": body, "sha256": hashlib.sha256(body.encode()).hexdigest()}))

    def _next(self, name: str, old: dict, **changes) -> None:
        self._publish(name, {**old, **changes, "generation": old["generation"] + 1})

    def _write(self, name: str, kind: str, df: DataFrame) -> str:
        path = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self._at(name)}/{path}")
        return path

    def _read(self, name: str, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self._at(name)}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    # Reads

    def points(self, name: str, manifest: dict | None = None) -> DataFrame:
        m = manifest or self.manifest(name)
        return without_deleted(self._read(name, m["points"], POINTS), self._read(name, m["tombstones"], TOMBSTONES))

    def point(self, name: str, point: str) -> DataFrame:
        return self.points(name).where(F.col("name") == point)

    def vectors(self, name: str, field: str | None = None, manifest: dict | None = None) -> DataFrame:
        """Live rows of sealed and buffered segments, with their source."""
        m = manifest or self.manifest(name)
        out = None
        for source in ("sealed", "buffer"):
            own = self._read(name, [s["path"] for s in m["segments"] if s["sealed"] == (source == "sealed")], VECTORS).withColumn("source", F.lit(source))
            out = own if out is None else out.unionByName(own)
        out = without_deleted(out, self._read(name, m["tombstones"], TOMBSTONES))
        return out if field is None else out.where(F.col("field") == field)

    # Writes

    def checked(self, name: str, points: DataFrame) -> DataFrame:
        """points with fault: why a row may not be written, or null."""
        collection = self.get(name)
        if collection is None:
            raise KeyError(name)
        widths = F.create_map(*[F.lit(x) for f in collection.fields for x in (f.name, f.dim)])
        entries = F.map_entries("vectors")
        width = lambda e: F.element_at(widths, e["key"])
        fault = (
            F.when(~F.coalesce(F.col("name").rlike(f"^{name}/points/[^/]+$"), F.lit(False)), "foreign parent")
            .when(F.exists(entries, lambda e: width(e).isNull()), "undeclared field")
            .when(F.exists(entries, lambda e: F.coalesce(F.size(e["value"]), F.lit(-1)) != F.coalesce(width(e), F.lit(-1))), "wrong width")
            .when(F.exists(entries, lambda e: ~F.coalesce(V.finite(e["value"]), F.lit(False))), "component that is not finite")
            .when(F.col("span").isNotNull() & ~F.coalesce((F.col("span.start_ms") >= 0) & (F.col("span.start_ms") <= F.col("span.end_ms")), F.lit(False)), "inverted span")
        )
        return points.withColumn("fault", fault)

    def append(self, name: str, points: DataFrame) -> int:
        """points: name, span, content_ref, vectors map<string, array<float>>. Whole or not at all; the number written."""
        if self.get(name) is None:
            raise KeyError(name)
        self.recover(name)
        return self._apply(name, self.log(name, points, check=True))

    # Log

    @staticmethod
    def _sum(rows: DataFrame) -> tuple[int, int]:
        """Number of rows and a checksum that does not depend on their order."""
        text = F.to_json(F.struct("name", "span", "content_ref", F.array_sort(F.map_entries("vectors")).alias("vectors")))
        return tuple(rows.agg(F.count("*"), F.coalesce(F.sum(F.crc32(text.cast("binary"))), F.lit(0))).first())

    def log(self, name: str, points: DataFrame, check: bool = False) -> int:
        """Write a batch to the log; its number. It counts as written once its marker is there.

        check: rows are checked as they lie there, so that points are made once; with a fault in one the entry goes.
        """
        numbers = [int(n) for n in files.names(self.spark, f"{self._at(name)}/log") if n.isdigit()]
        number = max([self.manifest(name)["logged"], *numbers]) + 1
        own = f"{self._at(name)}/log/{number}"
        points.select("name", F.col("span").cast("struct<start_ms:bigint,end_ms:bigint>").alias("span"), "content_ref", "vectors").write.parquet(f"{own}/rows")
        stored = self.spark.read.parquet(f"{own}/rows")
        bad = self.checked(name, stored).where("fault IS NOT NULL").select("name", "fault").limit(1).collect() if check else None
        if bad:
            files.delete(self.spark, own)
            raise ValueError(f"{bad[0][0]!r}: {bad[0][1]}")
        rows, checksum = self._sum(stored)
        files.write_text(self.spark, f"{own}/whole.json", json.dumps({"rows": rows, "sum": checksum}))
        return number

    def _entry(self, name: str, number: int) -> DataFrame | None:
        """A log entry's rows; None if it is torn."""
        own = f"{self._at(name)}/log/{number}"
        if not files.exists(self.spark, f"{own}/whole.json"):
            return None
        try:
            marker, rows = json.loads(files.read_text(self.spark, f"{own}/whole.json")), self.spark.read.parquet(f"{own}/rows")
            return rows if self._sum(rows) == (marker["rows"], marker["sum"]) else None
        except Exception as torn:  # a file of it is cut short or gone
            if "FAILED_READ_FILE" in str(torn) or "PATH_NOT_FOUND" in str(torn) or isinstance(torn, (ValueError, KeyError)) or "UNABLE_TO_INFER_SCHEMA" in str(torn) or "CANNOT_READ_FILE_FOOTER" in str(torn):
                return None
            raise

    def recover(self, name: str) -> int:
        """Apply what was logged and not published; drop the first torn entry and all after it. Entries applied."""
        numbers = sorted(n for n in map(int, filter(str.isdigit, files.names(self.spark, f"{self._at(name)}/log"))) if n > self.manifest(name)["logged"])
        applied, torn = 0, False
        for number in numbers:
            torn = torn or self._entry(name, number) is None
            if torn:
                files.delete(self.spark, f"{self._at(name)}/log/{number}")
            else:
                self._apply(name, number)
                applied += 1
        return applied

    def _apply(self, name: str, number: int) -> int:
        collection, m = self.get(name), self.manifest(name)
        fresh = new_only(self._entry(name, number), self.points(name, m)).dropDuplicates(["name"])
        numbered = files.kept(renumbered(fresh, F.lit(True), ["name"]), "numbered")
        n = numbered.count()
        changes = {}
        if n:
            unit = [f.name for f in collection.fields if f.metric == "cosine"]
            start = F.create_map(*[F.lit(x) for f in collection.fields for x in (f.name, m["next_row"].get(f.name, 0))])
            # A field's rows stay dense: points without its vector take a row too.
            long = numbered.withColumn("field", F.explode(F.array(*[F.lit(f.name) for f in collection.fields])))
            vec = F.element_at("vectors", F.col("field"))
            vec = F.when(F.col("field").isin(unit), V.normalise(vec).cast("array<float>")).otherwise(vec)
            segment = self._write(name, "buffer", long.select("field", (F.element_at(start, F.col("field")) + F.col("new_row")).alias("row"), "name", vec.alias("vec")))
            entry = {"id": max([s["id"] for s in m["segments"]], default=-1) + 1, "path": segment, "sealed": False, "rows": n * len(collection.fields)}
            changes = {"segments": [*m["segments"], entry], "points": [*m["points"], self._write(name, "points", numbered.select("name", "span", "content_ref"))], "next_row": {f.name: m["next_row"].get(f.name, 0) + n for f in collection.fields}}
        self._next(name, m, logged=number, **changes)
        files.delete(self.spark, f"{self._at(name)}/log/{number}")
        return n

    def delete(self, name: str, names: list[str] | DataFrame) -> None:
        m = self.manifest(name)
        gone = names if isinstance(names, DataFrame) else self.spark.createDataFrame([(n,) for n in names], TOMBSTONES)
        self._next(name, m, tombstones=[*m["tombstones"], self._write(name, "tombstones", gone.select("name").distinct())])

    def seal(self, name: str) -> None:
        """Buffer segments become one sealed segment, with codes of the fields that declare a codec."""
        m = self.manifest(name)
        buffered = [s for s in m["segments"] if not s["sealed"]]
        if buffered:
            path = self._write(name, "segment", self._read(name, [s["path"] for s in buffered], VECTORS))
            entry = {"id": max(s["id"] for s in m["segments"]) + 1, "path": path, "sealed": True, "rows": sum(s["rows"] for s in buffered), "codes": self._write_codes(name, path)}
            self._next(name, m, segments=[s for s in m["segments"] if s["sealed"]] + [entry])

    def _write_codes(self, name: str, path: str) -> dict:
        """Of each field with a codec: where its codes lie, and its codebook if it has one."""
        out = {}
        for f in self.get(name).fields:
            rows = self._read(name, [path], VECTORS).where((F.col("field") == f.name) & F.col("vec").isNotNull()).select("row", "vec")
            book = None
            if f.codec == "pq":
                sample = Q.sample(rows)
                parts = next(p for p in (8, 4, 2, 1) if f.dim % p == 0)
                if len(sample) < 256:  # too few rows for a codebook: searched exactly
                    continue
                book = Q.train_pq(sample, parts)
            if f.codec != "none":
                out[f.name] = {"path": self._write(name, "codes", A.encoded(rows, f.codec, book)), "codec": f.codec, "book": None if book is None else base64.b64encode(book.dump()).decode()}
        return out

    def compact(self, name: str) -> None:
        """One segment of live rows with new numbers; tombstones are then no longer needed."""
        m = self.manifest(name)
        live = self.vectors(name, manifest=m)
        rows = renumbered(live, F.lit(True), ["row"], "field").select("field", F.col("new_row").alias("row"), "name", "vec")
        path = self._write(name, "segment", rows)
        counts = {r["field"]: r["n"] for r in self._read(name, [path], VECTORS).groupBy("field").agg((F.max("row") + 1).alias("n")).collect()}
        points = self._write(name, "points", self.points(name, m))
        entry = {"id": max([s["id"] for s in m["segments"]], default=-1) + 1, "path": path, "sealed": True, "rows": sum(counts.values()), "codes": self._write_codes(name, path)}
        self._next(name, m, segments=[entry], points=[points], tombstones=[], next_row=counts, indexes={})

    # Search

    def build_index(self, name: str, field: str) -> None:
        """Build the declared kind of index over the rows there are now. Compaction renumbers rows and drops it."""
        m, spec = self.manifest(name), self.get(name).get(field)
        path = f"index-{uuid.uuid4().hex}"
        rows = self.vectors(name, field, m).where(F.col("vec").isNotNull()).select("row", "vec")
        INDEXES[spec.index].build(rows, spec.metric, f"{self._at(name)}/{path}")
        self._next(name, m, indexes={**m.get("indexes", {}), field: {"path": path, "kind": spec.index, "rows": m["next_row"].get(field, 0)}})

    def _near(self, name: str, field: str, queries: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
        """query_id, row, score, rank: by the index for what it covers, exactly for what came later."""
        m, spec = self.manifest(name), self.get(name).get(field)
        rows = self.vectors(name, field, m)
        if allowed is not None:
            rows = rows.join(allowed.select("name").distinct(), "name", "left_semi")
        built = m.get("indexes", {}).get(field)
        if built is None:
            return batch_topk(rows, queries, k, spec.metric)
        if allowed is not None and prefers_exact(rows.limit(built["rows"] // 100 + 1).count(), built["rows"]):
            return batch_topk(rows, queries, k, spec.metric)
        hidden = None
        if allowed is not None or m["tombstones"]:
            every = self._read(name, [s["path"] for s in m["segments"]], VECTORS).where((F.col("field") == field) & (F.col("row") < built["rows"])).select("row")
            hidden = every.join(rows.select("row"), "row", "left_anti")
        old = INDEXES[built["kind"]].search(self.spark, f"{self._at(name)}/{built['path']}", queries, k, spec.metric, hidden)
        new = batch_topk(rows.where(F.col("row") >= built["rows"]), queries, k, spec.metric)
        both = old.select("query_id", "row", "score").withColumn("source", F.lit("index")).unionByName(new.drop("rank").withColumn("source", F.lit("later")))
        return merge_sources(both, k, spec.metric, "row").drop("source")

    def search_coded(self, name: str, field: str, queries: DataFrame, k: int, n: int | None = None) -> DataFrame:
        """query_id, row, score, rank: candidates by the codes beside sealed segments, exact scores; segments without codes exactly."""
        m, spec = self.manifest(name), self.get(name).get(field)
        rows, parts = self.vectors(name, field, m), []
        for s in m["segments"]:
            own = rows if len(m["segments"]) == 1 else rows.join(self._read(name, [s["path"]], VECTORS).where(F.col("field") == field).select("row"), "row", "left_semi")
            codes = s.get("codes", {}).get(field)
            if codes is None:
                parts.append(batch_topk(own, queries, k, spec.metric))
                continue
            book = Q.Codebook.load(base64.b64decode(codes["book"])) if codes["book"] else None
            live = self._read(name, [codes["path"]], "row long, codes binary")
            live = live.join(own.select("row"), "row", "left_semi") if m["tombstones"] else live
            parts.append(A.two_tier(own.select("row", "vec"), live, queries, k, codes["codec"], spec.metric, n, book))
        out = None
        for i, p in enumerate(parts):
            p = p.select("query_id", "row", "score").withColumn("source", F.lit(str(i)))
            out = p if out is None else out.unionByName(p)
        return self.spark.createDataFrame([], "query_id long, row long, score double, rank long") if out is None else merge_sources(out, k, spec.metric, "row").drop("source")

    def search(self, name: str, field: str, query: list[float], k: int = 10, allowed: DataFrame | None = None, mask: str = "", skip: int = 0) -> DataFrame:
        """name, score, rank, source and the point's columns under the mask. Deleted and hidden rows never take a place.

        skip: answers of earlier pages; ranks go on counting. An unknown field has no answers.
        """
        if field not in {f.name for f in self.get(name).fields}:
            return self.spark.createDataFrame([], f"name string, score double, rank long, source string, {POINTS[POINTS.index('span'):]}")
        spec = self.get(name).get(field)
        if len(query) != spec.dim:
            raise ValueError(f"{field} has {spec.dim} dimensions, the query {len(query)}")
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, vec array<double>")
        best = self._near(name, field, one, k + skip, allowed).where(F.col("rank") > skip).select("row", "score", "rank")  # k rows
        owners = self.vectors(name, field).select("row", "name", "source").join(F.broadcast(best), "row")
        found = self.points(name).join(F.broadcast(owners.select("name", "score", "rank", "source")), "name")
        found = found.select("name", "score", "rank", "source", "span", "content_ref").orderBy("rank")
        return found if not mask else masked(found, f"score,rank,source,{mask}")

    def search_many(self, name: str, field: str, queries: DataFrame, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
        return self._near(name, field, queries, k, allowed)

    def merged(self, name: str, field: str, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, name, source, score, rank: exact answers of sealed segments and the buffer, merged."""
        rows, spec, parts = self.vectors(name, field), self.get(name).get(field), []
        for source in ("sealed", "buffer"):
            parts.append(batch_topk(rows.where(F.col("source") == source), queries, k, spec.metric).drop("rank").withColumn("source", F.lit(source)))
        return merge_sources(parts[0].unionByName(parts[1]), k, spec.metric, "row").join(rows.select("row", "name"), "row").select("query_id", "name", "source", "score", "rank")

    def sampled_recall(self, name: str, field: str, queries: DataFrame, k: int = 10, one_in: int = 100) -> DataFrame:
        """queries, mean_recall, worst_recall of one in so many queries (by a hash of the id), held against exact search as they are served."""
        m, spec = self.manifest(name), self.get(name).get(field)
        some = files.kept(queries.where(F.pmod(F.xxhash64("query_id", F.lit(23)), F.lit(one_in)) == 0), "sampled")
        return recall_report(recall(batch_topk(self.vectors(name, field, m), some, k, spec.metric), self._near(name, field, some, k, None), k))
