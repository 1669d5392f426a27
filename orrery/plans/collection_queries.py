"""Queries over collections on files: what is written, logged, sealed, compacted, searched and read again.

Each makes a collection of its own in the shared scratch folder from the driver's tables and states in SQL what must
come out of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.client import BatchError, Collection, connect
from orrery.functions.filters import masked
from orrery.operators import flat, graph
from orrery.plans.registry import _BATCH, _DOT, _EDGES, _L2, _Q0, _QS, _WORDS, LEAST_RECALL, _customer_seeds, _rounded, _seeds, edges, first_vector, query, search_queries, table, vectors
from orrery.sources import edges as E
from orrery.sources import files, ingest, schema

_NAME = "'c/points/' || vec_id"


def _points(rows: DataFrame, field: str = "v", span: bool = False) -> DataFrame:
    """Points of a collection c from vectors (row, vec): each third row has no vector if span is set, and each second a span."""
    none = F.lit(None)
    own = F.when(F.col("row") % 2 == 0, F.struct(F.col("row").alias("start_ms"), (F.col("row") * 2).alias("end_ms"))) if span else none.cast("struct<start_ms:bigint,end_ms:bigint>")
    vec = F.when(F.col("row") % 3 != 0, F.create_map(F.lit(field), F.col("vec"))).otherwise(F.create_map().cast("map<string,array<float>>")) if span else F.create_map(F.lit(field), F.col("vec"))
    ref = none.cast("struct<uri:string,range_start:bigint,range_end:bigint,sha256:binary,inline_text:string>")
    return rows.select(F.concat(F.lit("c/points/"), F.col("row").cast("string")).alias("name"), own.alias("span"), ref.alias("content_ref"), vec.alias("vectors"))


def _collection(spark: SparkSession, rows: DataFrame, metric: str = "dot", index: str = "flat", codec: str = "none", span: bool = False) -> Collection:
    """A collection c with field v of these vectors."""
    dim = rows.select(F.size("vec").alias("dim")).first()["dim"]
    c = connect(spark, files.scratch(spark, "store")).create_collection("c").field("v", dim, metric, index, codec).create()
    c.insert_frame(_points(rows, span=span))
    return c


def _row(name: str = "name"):
    return F.substring_index(F.col(name), "/", -1).cast("long")


# Sources and sinks -------------------------------------------------------------------------------------


@query("SELECT vec_id AS row, round(list_sum(embedding::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS total, len(embedding)::BIGINT AS dim FROM embeddings WHERE vec_id % 3 <> 0")
def vector_store(spark, sf):
    """A field's vectors by row, of unit length as the field is cosine; absent ones are told apart."""
    c = _collection(spark, vectors(spark, sf), "cosine", span=True)
    held = c._store.vectors("c", "v").where("vec IS NOT NULL")
    return held.select(_row().alias("row"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.size("vec").cast("long").alias("dim"))


@query("SELECT row_number() OVER (ORDER BY 'c/points/' || vec_id) - 1 AS number, vec_id AS row, vec_id % 3 <> 0 AS present FROM embeddings")
def sealed_rows(spark, sf):
    """Dense row numbers in the order of names; a point without a vector takes a row too."""
    c = _collection(spark, vectors(spark, sf), span=True)
    c._store.seal("c")
    return c._store.vectors("c", "v").where("source = 'sealed'").select(F.col("row").alias("number"), _row().alias("row"), F.col("vec").isNotNull().alias("present"))


@query(f"""WITH {_BATCH} SELECT query_id, row, CASE WHEN row % 4 = 0 THEN 'buffer' ELSE 'sealed' END AS source, round(score, 6) AS score, rank::BIGINT AS rank FROM b WHERE rank <= 10""")
def buffer_and_sealed_search(spark, sf):
    """What was just written is found beside what is sealed."""
    rows = vectors(spark, sf)
    c = _collection(spark, rows.where("row % 4 <> 0"))
    c._store.seal("c")
    c.insert_frame(_points(rows.where("row % 4 = 0")))
    found = c._store.merged("c", "v", search_queries(spark, sf), 10)
    return _rounded(found.select("query_id", _row().alias("row"), "source", "score", "rank"), "score")


@query("SELECT vec_id AS row, CASE WHEN vec_id % 2 = 0 THEN vec_id END AS start_ms, CASE WHEN vec_id % 2 = 0 THEN vec_id * 2 END AS end_ms FROM embeddings")
def point_spans(spark, sf):
    c = _collection(spark, vectors(spark, sf), span=True)
    return c._store.points("c").select(_row().alias("row"), F.col("span.start_ms").alias("start_ms"), F.col("span.end_ms").alias("end_ms"))


@query("SELECT vec_id AS row, CASE WHEN vec_id % 2 = 0 THEN vec_id * 2 END AS end_ms FROM embeddings WHERE vec_id % 20 = 0")
def point_get(spark, sf):
    """Points by their full names."""
    c = _collection(spark, vectors(spark, sf), span=True)
    wanted = vectors(spark, sf).where("row % 20 = 0").select(F.concat(F.lit("c/points/"), F.col("row").cast("string")).alias("name"))
    return c._store.points("c").join(wanted, "name").select(_row().alias("row"), F.col("span.end_ms").alias("end_ms"))


@query("SELECT count(*) AS points, 2::BIGINT AS segments, 3::BIGINT AS generation, 3::BIGINT AS whole FROM embeddings")
def manifest_checksum(spark, sf):
    """A torn manifest is passed over for the newest whole one; a generation cannot be published twice."""
    rows = vectors(spark, sf)
    c = _collection(spark, rows.where("row % 2 = 0"))
    c.insert_frame(_points(rows.where("row % 2 = 1")))
    c._store.delete("c", ["c/points/none"])
    before = c._store.manifest("c")
    files.write_text(spark, f"{c._store._at('c')}/manifest/{before['generation'] + 1}.json", '{"body": "{}", "sha256": "0"')
    held = int(c._store.manifest("c") == before)
    try:
        c._store._publish("c", before)
    except FileExistsError:
        held += 1
    held += int(len(before["segments"]) == 2)
    return c._store.points("c").agg(F.count("*").alias("points")).select("points", F.lit(len(before["segments"])).cast("long").alias("segments"), F.lit(before["generation"]).cast("long").alias("generation"), F.lit(held).cast("long").alias("whole"))


@query("SELECT vec_id AS row FROM embeddings WHERE vec_id % 4 < 3")
def log_recovery(spark, sf):
    """Logged and not published: applied; the torn entry and what follows it: dropped."""
    rows = vectors(spark, sf)
    c = _collection(spark, rows.where("row % 4 = 0"))
    for part in (1, 2):
        c._store.log("c", _points(rows.where(F.col("row") % 4 == part)))
    torn = c._store.log("c", _points(rows.where("row % 4 = 3")))
    files.write_text(spark, f"{c._store._at('c')}/log/{torn}/whole.json", '{"rows": 1, "su', overwrite=True)
    c._store.log("c", _points(rows.where("row = 3")))
    c._store.recover("c")
    return c._store.points("c").select(_row().alias("row"))


@query("SELECT 7::BIGINT AS failing_index, 0::BIGINT AS written, 0::BIGINT AS points_after, 5::BIGINT AS refused")
def batch_create_result(spark, sf):
    """A batch with a bad point names its place and writes nothing; so do those with other faults; an empty batch is refused."""
    some = [[float(x) for x in r["vec"]] for r in vectors(spark, sf).orderBy("row").limit(10).collect()]
    c = connect(spark, files.scratch(spark, "store")).create_collection("c").field("v", len(some[0]), "dot").create()
    index = written = -1
    try:
        c.insert_many([(str(i), {"v": v if i != 7 else v[:-1]}) for i, v in enumerate(some)])
    except BatchError as bad:
        index, written = bad.index, bad.written
    refused = 0
    for batch in ([], [("a/b", {"v": some[0]})], [("a", {"w": some[0]})], [("a", {"v": [float("nan"), *some[0][1:]]})], [("a", {"v": []})]):
        try:
            c.insert_many(batch)
        except ValueError:
            refused += 1
    return spark.createDataFrame([(index, written, c.list().count(), refused)], "failing_index long, written long, points_after long, refused long")


@query("SELECT 'r/' || r_name AS name, r_regionkey + 2 AS dim FROM region WHERE r_regionkey <> 3")
def collection_catalog(spark, sf):
    """Collections are declared, listed and dropped."""
    client = connect(spark, files.scratch(spark, "store"))
    for r in table(spark, sf, "region").collect():
        client.create_collection(f"r/{r['r_name']}").field("v", r["r_regionkey"] + 2).create()
    gone = table(spark, sf, "region").where("r_regionkey = 3").first()["r_name"]
    client.delete_collection(f"r/{gone}")
    return spark.createDataFrame([(n, client.collection(n).declared.get("v").dim) for n in client.list_collections()], "name string, dim int")


@query("""SELECT s_suppkey::VARCHAR AS id, 'He said "' || s_name || '", then' || chr(10) || 'left' AS text FROM supplier WHERE s_suppkey % 5 <> 0""")
def csv_source(spark, sf):
    """Quotes, doubled quotes and line ends inside quotes survive a file; rows without text go."""
    path = files.scratch(spark, "csv")
    text = F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit('He said "'), F.col("s_name"), F.lit('", then\nleft'))).otherwise(F.lit("  "))
    ingest.bulk_export(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), text.alias("text")), path, "csv")
    return ingest.csv_points(ingest.read_csv(spark, path), "id", "text", "id")


@query("SELECT o_custkey::VARCHAR AS query_id, o_orderkey::VARCHAR AS doc_id, (o_orderkey % 4)::INTEGER AS grade FROM orders WHERE o_orderkey % 4 > 0")
def judgements_source(spark, sf):
    path = files.scratch(spark, "tsv")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("query-id"), F.col("o_orderkey").alias("corpus-id"), (F.col("o_orderkey") % 4).alias("score"))
    rows.write.csv(path, sep="\t", header=True)
    return ingest.read_judgements(spark, path)


@query("SELECT vec_id AS row, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: i * embedding[i]::DOUBLE)), 5) AS total FROM embeddings")
def fvecs_source(spark, sf):
    """Vectors written as records of width and little-endian values."""
    import numpy as np

    rows = vectors(spark, sf).select("row", "vec").orderBy("row").collect()
    data = b"".join(np.int32(len(r["vec"])).tobytes() + np.array(r["vec"], "<f4").tobytes() for r in rows)
    path = files.scratch(spark, "fvecs")
    files.write_bytes(spark, f"{path}/base.fvecs", data)
    order = spark.createDataFrame([(i, r["row"]) for i, r in enumerate(rows)], "place long, id long")
    read = ingest.read_vectors(spark, path).withColumnRenamed("row", "place").join(order, "place")
    return read.select(F.col("id").alias("row"), F.round(F.aggregate(F.transform("vec", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("SELECT kind, o_orderkey, o_orderstatus, o_totalprice FROM orders, (SELECT unnest(['parquet', 'json', 'csv']) AS kind)")
def bulk_files(spark, sf):
    """Export and import by each kind of file."""
    rows, out = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), None
    for kind in ("parquet", "json", "csv"):
        path = files.scratch(spark, kind)
        ingest.bulk_export(rows, path, kind)
        back = ingest.bulk_import(spark, path, kind, "o_orderkey long, o_orderstatus string, o_totalprice double").withColumn("kind", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out


# Life of a collection ----------------------------------------------------------------------------------


@query("SELECT vec_id AS row FROM embeddings WHERE vec_id % 7 <> 0")
def append_seal_compact(spark, sf):
    """Points after two writes, of which the second repeats the first's, a deletion, sealing and compaction."""
    rows = vectors(spark, sf)
    c = _collection(spark, rows.where("row % 2 = 0"))
    c.insert_frame(_points(rows))
    c._store.seal("c")
    c._store.delete("c", rows.where("row % 7 = 0").select(F.concat(F.lit("c/points/"), F.col("row").cast("string")).alias("name")))
    c._store.compact("c")
    assert not c._store.manifest("c")["tombstones"]
    return c._store.vectors("c", "v").select(_row().alias("row"))


@query(f"WITH {_QS}, t AS (SELECT query_id, vec_id AS row, {_DOT} AS score FROM embeddings, qs WHERE vec_id % 7 <> 0), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row) AS rank FROM t) SELECT query_id, row, round(score, 6) AS score, rank::BIGINT AS rank FROM b WHERE rank <= 10")
def sealed_codes_search(spark, sf):
    """Codes written at sealing find candidates (half floats here), exact scores decide; deleted rows take no place."""
    rows = vectors(spark, sf)
    c = _collection(spark, rows.where("row % 5 <> 0"), codec="f16")
    c._store.seal("c")
    c.insert_frame(_points(rows.where("row % 5 = 0")))
    c._store.delete("c", rows.where("row % 7 = 0").select(F.concat(F.lit("c/points/"), F.col("row").cast("string")).alias("name")))
    found = c._store.search_coded("c", "v", search_queries(spark, sf), 10, 64)
    named = found.join(c._store.vectors("c", "v").select("row", "name"), "row")
    # Ranks by point, as rows are numbered by name.
    own = flat.rank_by(named.select("query_id", _row().alias("row"), "score"), "query_id", 10, "dot", "row")
    return _rounded(own, "score")


@query("SELECT n_nationkey::BIGINT AS n, CASE WHEN n_nationkey % 4 >= 2 THEN 'vault' ELSE n_name END || '[' || n_regionkey || ']' AS label FROM nation")
def redacted_labels(spark, sf):
    kinds = ("none", "private", "vault", "sealed")
    rows = table(spark, sf, "nation").collect()
    return spark.createDataFrame([(r["n_nationkey"], schema.redacted(r["n_name"], kinds[r["n_nationkey"] % 4], r["n_regionkey"])) for r in rows], "n long, label string")


# Searches of collections -------------------------------------------------------------------------------


@query(f"""WITH {_Q0}, r AS (SELECT {_NAME} AS name, {_DOT} AS score, vec_id, row_number() OVER (ORDER BY {_DOT} DESC, {_NAME}) AS rank FROM embeddings, q0 WHERE vec_id % 3 <> 0)
    SELECT name, CASE WHEN vec_id % 2 = 0 THEN vec_id END AS start_ms, round(score, 6) AS score, rank::BIGINT AS rank FROM r WHERE rank <= 25""")
def search_pages(spark, sf):
    """Three pages of a search, under a mask: names and starts of spans."""
    c = _collection(spark, vectors(spark, sf), span=True)
    q, token, out = first_vector(spark, sf), "", None
    for k in (10, 10, 5):
        hits = c.search("v", q, k, mask="name,span.start_ms", page_token=token)
        page = hits.frame.select("name", F.col("span.start_ms").alias("start_ms"), "score", "rank")
        out, token = page if out is None else out.unionByName(page), hits.next_page_token
    return _rounded(out, "score")


@query("SELECT count(*) FILTER (vec_id % 3 <> 0) AS rows, FALSE AS is_complete, 'b,d' AS locked, TRUE AS more, 0::BIGINT AS unknown_field FROM embeddings")
def search_statistics(spark, sf):
    """What a search could have found, whether all spaces were open, and whether there is a next page."""
    c = _collection(spark, vectors(spark, sf), span=True)
    spaces = spark.createDataFrame([("a", "none"), ("b", "vault"), ("c", "private"), ("d", "sealed")], "name string, protection string")
    hits = c.search("v", first_vector(spark, sf), 5, spaces=spaces)
    none = c._store.search("c", "w", [0.0], 5).count()
    return spark.createDataFrame([(sum(hits.stats.values()), hits.is_complete, ",".join(hits.locked_spaces), bool(hits.next_page_token), none)], "rows long, is_complete boolean, locked string, more boolean, unknown_field long")


@query(f"""WITH {_WORDS}, p AS (SELECT b.doc_id AS row, sum(a.x * b.x) AS score FROM v a JOIN v b ON a.slot = b.slot WHERE a.doc_id = (SELECT min(doc_id) FROM documents WHERE length(text) > 200) GROUP BY ALL)
    SELECT count(*) FILTER (round(score, 5) >= 1.0) > 0 AS found_itself, TRUE AS ordered FROM p""")
def collection_text_search(spark, sf):
    """Texts are added and found by a text."""
    docs = table(spark, sf, "documents")
    c = connect(spark, files.scratch(spark, "store")).create_collection("c").text_field("text").create()
    c.add_texts(docs.select(F.col("doc_id").cast("string").alias("id"), "text"), "text")
    text = docs.where("length(text) > 200").orderBy("doc_id").first()["text"]
    scores = [r["score"] for r in c.search_text("text", text, 5).rows()]
    return spark.createDataFrame([(round(scores[0], 5) >= 1.0, scores == sorted(scores, reverse=True))], "found_itself boolean, ordered boolean")


@query("SELECT TRUE AS sampled, TRUE AS enough")
def live_recall(spark, sf):
    """Some of the queries that are served are also answered exactly, and the recall is reported."""
    c = _collection(spark, vectors(spark, sf), index="ivf")
    c._store.build_index("c", "v")
    r = c._store.sampled_recall("c", "v", search_queries(spark, sf), 10, 3).first()
    return spark.createDataFrame([(0 < r["queries"] < search_queries(spark, sf).count(), r["mean_recall"] >= LEAST_RECALL)], "sampled boolean, enough boolean")


@query("SELECT kind, TRUE AS enough FROM (SELECT unnest(['flat', 'hnsw', 'ivf', 'ivfpq', 'int8', 'f16', 'binary', 'pq']) AS kind)")
def declared_indexes(spark, sf):
    """Each kind of index, built and searched, with rows that came later and rows that were deleted."""
    rows, qs, out = vectors(spark, sf), search_queries(spark, sf), []
    gone = rows.where("row % 11 = 0").select(F.concat(F.lit("c/points/"), F.col("row").cast("string")).alias("name"))
    for kind in ("flat", "hnsw", "ivf", "ivfpq", "int8", "f16", "binary", "pq"):
        c = _collection(spark, rows.where("row % 6 <> 0"), index=kind)
        c._store.build_index("c", "v")
        c.insert_frame(_points(rows.where("row % 6 = 0")))
        c._store.delete("c", gone)
        live = c._store.vectors("c", "v")
        truth = flat.batch_topk(live, qs, 10, "dot")
        out.append((kind, flat.recall_report(flat.recall(truth, c._store.search_many("c", "v", qs, 10), 10)).first()["mean_recall"] >= LEAST_RECALL))
    return spark.createDataFrame(out, "kind string, enough boolean")


# Projections, edges, context ---------------------------------------------------------------------------


@query("SELECT o_orderkey, {'start': o_custkey, 'end': o_custkey + 1} AS span FROM orders")
def field_mask(spark, sf):
    """Only masked fields are read; parts of a struct stay in it."""
    span = F.struct(F.col("o_custkey").alias("start"), F.lit("x").alias("unit"), (F.col("o_custkey") + 1).alias("end"))
    return masked(table(spark, sf, "orders").withColumn("span", span), "o_orderkey, span.start, span.end")


@query("SELECT l_returnflag || '-' || l_linestatus AS kind, round(l_extendedprice * (1 - l_discount), 4) AS net, CASE WHEN l_quantity BETWEEN 10 AND 20 THEN 'some' WHEN l_quantity > 20 THEN 'many' ELSE 'few' END AS amount FROM lineitem WHERE l_shipdate < DATE '1997-01-01' AND l_tax >= 0.02 AND l_discount <> 0.05")
def general_expressions(spark, sf):
    many = F.when(F.col("l_quantity").between(10, 20), "some").when(F.col("l_quantity") > 20, "many").otherwise("few")
    own = table(spark, sf, "lineitem").where("l_shipdate < DATE '1997-01-01' AND l_tax >= 0.02 AND l_discount <> 0.05")
    return own.select(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("kind"), F.round(F.expr("l_extendedprice * (1 - l_discount)"), 4).alias("net"), many.alias("amount"))


@query("""SELECT 'c/' || l_orderkey AS src, l_returnflag AS edge_type, 'p/' || l_partkey AS dst, l_quantity >= 5 AND l_returnflag <> 'A' AS written, CASE WHEN l_returnflag = 'A' THEN 'the type is missing' WHEN l_quantity < 5 THEN 'the weight is no number' END AS fault
    FROM (SELECT DISTINCT ON (l_orderkey, l_returnflag, l_partkey) * FROM lineitem ORDER BY l_orderkey, l_returnflag, l_partkey, l_linenumber)""".replace("l_returnflag AS edge_type", "CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END AS edge_type"))
def edge_batch_result(spark, sf):
    """What became of each write of a batch."""
    first = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_partkey").agg(F.min_by("l_quantity", "l_linenumber").alias("q"))
    kind = F.when(F.col("l_returnflag") == "A", "").otherwise(F.col("l_returnflag"))
    writes = first.select(F.concat(F.lit("c/"), F.col("l_orderkey").cast("string")).alias("src"), kind.alias("edge_type"), F.concat(F.lit("p/"), F.col("l_partkey").cast("string")).alias("dst"), F.when(F.col("q") >= 5, F.col("q")).alias("weight"), F.lit(1).alias("seq"))
    return E.insert(writes.limit(0), writes)[1]


@query(f"WITH {_EDGES} SELECT edge_type, count(*) AS n FROM edges WHERE edge_type NOT IN ('PLACED', 'CONTAINS', 'IN_REGION', 'IN_NATION') OR edge_type = 'IN_NATION' GROUP BY edge_type")
def edge_types(spark, sf):
    """Edges that no declared type allows: those never declared, and those whose ends are of another kind. A type in use cannot be undeclared."""
    kind = "edge_type string, src_kind string, dst_kind string, structural boolean"
    types = spark.createDataFrame([("PLACED", "customer", "order", False), ("CONTAINS", "order", None, True), ("IN_NATION", "customer", "region", True)], kind)
    types = E.declare(types, spark.createDataFrame([("IN_REGION", None, None, True), ("PLACED", None, None, True), ("UNUSED", None, None, False)], kind))
    own = edges(spark, sf)
    types = E.undeclare(types, spark.createDataFrame([("UNUSED",), ("PLACED",)], "edge_type string"), own)
    return E.undeclared(types, own).groupBy("edge_type").agg(F.count("*").alias("n"))


@query(f"""WITH {_EDGES}, {_Q0}, s AS (SELECT vec_id, 'vec/' || vec_id AS name, {_DOT} AS score FROM embeddings, q0 ORDER BY score DESC, vec_id LIMIT 10),
    rk AS (SELECT name, score, row_number() OVER (ORDER BY score DESC, name) AS sr FROM s),
    p AS (SELECT e.dst AS name, rk.score * 0.65 AS score, sr FROM rk JOIN edges e ON e.src = rk.name WHERE e.dst NOT IN (SELECT name FROM s)),
    a AS (SELECT name, score FROM s UNION ALL SELECT name, max(score) FROM p GROUP BY name),
    t AS (SELECT a.*, length(d.text) AS tokens FROM a JOIN documents d ON a.name = 'vec/' || d.doc_id),
    r AS (SELECT name, row_number() OVER (ORDER BY score DESC, name) AS position, sum(tokens) OVER (ORDER BY score DESC, name ROWS UNBOUNDED PRECEDING) AS running_tokens FROM t)
    SELECT name, position::BIGINT AS position, running_tokens::BIGINT AS running_tokens, FALSE AS region_suppressed FROM r WHERE position <= 8 AND running_tokens <= 20000""")
def context_assembly(spark, sf):
    """From a search over its neighbours in the graph to the texts that fit both budgets."""
    texts = table(spark, sf, "documents").select(F.concat(F.lit("vec/"), F.col("doc_id").cast("string")).alias("name"), "text", F.length("text").alias("tokens"))
    out = graph.assemble(_seeds(spark, sf, "dot"), edges(spark, sf), texts, 20000, 8, metric="dot")
    return out.select("name", "position", F.col("running_tokens").cast("long").alias("running_tokens"), "region_suppressed")


@query("SELECT TRUE AS region_suppressed, count(*) > 0 AS found FROM customer")
def context_suppressed(spark, sf):
    """Suppressed edges that leave what was reached are reported."""
    seeds = _customer_seeds(spark, sf).withColumn("score", F.lit(1.0))
    texts = seeds.select("name", F.col("name").alias("text"), F.lit(1).alias("tokens"))
    out = graph.assemble(seeds, edges(spark, sf), texts, 100, 50, metric="dot", suppressed=F.col("edge_type") == "PLACED")
    return out.groupBy("region_suppressed").agg((F.count("*") > 0).alias("found"))


@query("SELECT 'organizations/a/spaces/' || n_nationkey AS name FROM nation WHERE n_nationkey IN (1, 3)")
def tenant_calls(spark, sf):
    """Spaces are created, deleted and restored by a client."""
    client = connect(spark, files.scratch(spark, "store"))
    for n in (1, 2, 3):
        client.create_tenant(f"organizations/a/spaces/{n}")
    for n in (2, 3):
        client.delete_tenant(f"organizations/a/spaces/{n}")
    client.undelete_tenant("organizations/a/spaces/3")
    return spark.createDataFrame([(n,) for n in client.list_tenants("organizations/a", "spaces")], "name string")


@query(f"WITH {_Q0}, r AS (SELECT vec_id AS row, {_L2} AS d FROM embeddings, q0) SELECT row, round(d, 6) AS score FROM r ORDER BY round(d, 9), row LIMIT 3")
def insert_with_text(spark, sf):
    """Points with a vector and a text are found by the vector, with their text."""
    rows = vectors(spark, sf).orderBy("row").limit(1).collect()
    near = flat.batch_topk(vectors(spark, sf), spark.createDataFrame([(0, [float(x) for x in rows[0]["vec"]])], "query_id long, vec array<double>"), 3, "l2", digits=9)
    kept = vectors(spark, sf).join(F.broadcast(near.select("row")), "row").collect()
    c = connect(spark, files.scratch(spark, "store")).create_collection("c").field("v", len(rows[0]["vec"]), "l2").create()
    for r in kept:
        c.insert_with_text(str(r["row"]), f"text {r['row']}", (0, 1), v=list(r["vec"]))
    hits = c.search("v", first_vector(spark, sf), 3).frame.where(F.col("content_ref.inline_text") == F.concat(F.lit("text "), F.substring_index("name", "/", -1)))
    return _rounded(hits.select(_row().alias("row"), F.abs("score").alias("score")), "score")
