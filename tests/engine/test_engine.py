import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.client import connect
from orrery.functions import filters as P
from orrery.functions import names as N
from orrery.functions import vectors as V
from orrery.operators import approximate as A
from orrery.operators import flat, graph
from orrery.operators import quantize as Q
from orrery.sources import ingest, schema, store, tenancy


def clustered(n, dim, seed=1, centres=24):
    rnd = np.random.default_rng(seed)
    c = rnd.uniform(-1, 1, (centres, dim))
    x = c[np.arange(n) % centres] + 0.15 * rnd.normal(0, 0.7, (n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def corpus(spark):
    x = clustered(3000, 32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, vec array<float>").repartition(4).cache()
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(40, 32, 9))], "query_id long, vec array<float>")
    return rows, queries


def as_set(df):
    return {(r.query_id, r.row) for r in df.collect()}


@pytest.mark.parametrize("metric", ["dot", "l2", "cosine"])
def test_batch_equals_single(spark, corpus, metric):
    rows, queries = corpus
    batch = flat.batch_topk(rows, queries, 5, metric)
    one = queries.where("query_id = 3").first()
    single = flat.topk(rows, [float(v) for v in one["vec"]], 5, metric)
    assert [r.row for r in batch.where("query_id = 3").orderBy("rank").collect()] == [r.row for r in single.orderBy("rank").collect()]


def test_topk_edges(spark):
    rows = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (0, None), (3, [0.0, 1.0])], "row long, vec array<float>")
    assert [r.row for r in flat.topk(rows, [1.0, 0.0], 2, "dot").orderBy("rank").collect()] == [1, 2]
    assert flat.topk(rows, [1.0, 0.0], 0, "dot").count() == 0
    assert flat.topk(rows, [1.0, 0.0], 10, "dot").count() == 3
    assert [r.row for r in flat.topk(rows, [1.0, 0.0], 2, "dot", F.col("row") > 1).orderBy("rank").collect()] == [2, 3]
    with pytest.raises(Exception, match="dimensions"):
        flat.topk(rows, [1.0], 2, "dot").collect()


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_recall_of_approximate_search(spark, corpus, metric):
    rows, queries = corpus
    truth = flat.batch_topk(rows, queries, 10, metric).cache()
    mean = lambda found: flat.recall_report(flat.recall(truth, found, 10)).first()
    graphs = A.build_graphs(rows.where("row < 1200"), metric, 2, 12, 60)
    some = flat.batch_topk(rows.where("row < 1200"), queries, 10, metric)
    got = flat.recall_report(flat.recall(some, A.graph_search(graphs, queries, 10, 64, metric), 10)).first()
    assert not any(r.row < 600 for r in A.graph_search(graphs, queries, 5, 64, metric, spark.range(600).withColumnRenamed("id", "row")).collect())
    assert got.mean_recall >= 0.95 and got.worst_recall >= 0.5
    centroids = A.fit_lists(rows, 16)
    assigned = A.assign(rows, centroids)
    assert as_set(A.ivf_search(assigned, centroids, queries, 10, 16, metric)) == as_set(truth)
    few, more = (mean(A.ivf_search(assigned, centroids, queries, 10, n, metric)).mean_recall for n in (1, 6))
    assert few <= more and more >= 0.9
    probes = A.probes_by_recall(assigned, centroids, 10, metric)
    alike = rows.where("row % 40 = 7").select(F.col("row").alias("query_id"), "vec")
    mean_alike = lambda found: flat.recall_report(flat.recall(flat.batch_topk(rows, alike, 10, metric), found, 10)).first().mean_recall
    assert mean_alike(A.ivf_search(assigned, centroids, alike, 10, probes, metric)) >= 0.9
    book = A.residual_book(assigned, centroids)
    codes = A.residual_codes(assigned, centroids, book).cache()
    n = A.candidates_by_recall(rows, lambda q, n: A.code_search(codes, centroids, book, q, n, 16, metric), 10, metric)
    assert mean_alike(A.ivfpq_search(assigned, centroids, alike, 10, 16, 8, metric, n=n)) >= 0.9
    assert mean(A.two_tier_f16(rows, queries, 10, metric)).mean_recall >= 0.99
    assert mean(A.two_tier_pq(rows, queries, 10, Q.train_pq(Q.sample(rows), 8, 6), metric, 32.0)).mean_recall >= 0.85


def test_codecs(spark, corpus):
    rows, _ = corpus
    x = Q.sample(rows.limit(50))
    book = Q.Codebook(np.random.default_rng(1).normal(size=(4, 256, 8)))
    assert np.allclose(Q.Codebook.load(book.dump()).centroids, book.centroids, atol=1e-6)
    with pytest.raises(ValueError):
        Q.Codebook.load(book.dump()[:-4])
    assert book.decode(book.encode(x)).shape == x.shape
    flat_row = spark.createDataFrame([([2.0, 2.0],)], "vec array<float>").select(V.int8_scale(F.col("vec")).alias("r")).first()["r"]
    assert flat_row["scale"] == 0 and flat_row["offset"] == 2
    graph_ = A.SmallWorld(x, "l2", 4, 20)
    again = A.SmallWorld.load(graph_.dump())
    assert [r for _, r in again.search(x[7], 3)] == [r for _, r in graph_.search(x[7], 3)] and again.search(x[7], 1)[0][1] == 7
    hidden = np.ones(len(x), bool)
    hidden[7] = False
    assert 7 not in [r for _, r in graph_.search(x[7], 5, allowed=hidden)]
    assert A.SmallWorld(x[:0], "dot").search(x[0], 3) == []


def edges_of(spark, rows):
    return spark.createDataFrame([(*r, 1.0) for r in rows], "src string, edge_type string, dst string, weight double")


def hop(spark, e, hops, **more):
    return {(r.name, r.hops) for r in graph.k_hop(spark.createDataFrame([("seed",)], "name string"), e, hops, **more).collect()}


def test_k_hop(spark):
    e = edges_of(spark, [("seed", "NEXT", "a"), ("a", "NEXT", "b"), ("b", "NEXT", "c"), ("seed", "MENTIONS", "c"), ("c", "NEXT", "seed")])
    assert hop(spark, e, 0) == set()
    assert hop(spark, e, 1) == {("a", 1), ("c", 1)}
    assert hop(spark, e, 3) == {("a", 1), ("c", 1), ("b", 2)}
    assert hop(spark, e, 3, edge_type="NEXT") == {("a", 1), ("b", 2), ("c", 3)}
    shown = spark.createDataFrame([("b",), ("c",)], "name string")
    assert hop(spark, e, 3, visible=shown) == {("c", 1)}


def expand(spark, seeds, e, **more):
    return [(r.name, round(r.score, 6), r.hops, r.via) for r in graph.expand(spark.createDataFrame(seeds, "name string, score double"), e, **more).collect()]


def test_expand(spark):
    e = edges_of(spark, [("doc", "MENTIONS", "entity"), ("entity", "MENTIONS", "far"), ("doc", "CITES", "other"), ("x", "CITES", "entity")])
    assert expand(spark, [("doc", 1.0)], e, hops=2) == [("doc", 1.0, 0, None), ("entity", 0.65, 1, "doc"), ("other", 0.65, 1, "doc"), ("far", 0.4225, 2, "doc")]
    assert expand(spark, [("doc", 1.0)], e, edge_types=["CITES"]) == [("doc", 1.0, 0, None), ("other", 0.65, 1, "doc")]
    assert expand(spark, [("doc", 0.5), ("x", 1.0), ("x", 0.2)], e) == [("x", 1.0, 0, None), ("entity", 0.65, 1, "x"), ("doc", 0.5, 0, None), ("other", 0.325, 1, "doc")]
    assert expand(spark, [("doc", 2.0)], e, metric="l2")[1:] == [("entity", round(2 / 0.65, 6), 1, "doc"), ("other", round(2 / 0.65, 6), 1, "doc")]
    assert len(expand(spark, [("doc", 1.0)], e, budget=1)) == 2
    shown = spark.createDataFrame([("entity",), ("far",)], "name string")
    assert expand(spark, [("doc", 1.0)], e, visible=shown) == []


def test_names_and_filters(spark):
    df = spark.createDataFrame([("a/b/points/1", 5, "x1", None), ("a/b/points/1/points/2", 7, "y", 3)], "name string, n int, t string, m int")
    got = df.select(N.leaf(F.col("name")), N.parent(F.col("name")), N.matches(F.col("name"), "a/*/points/*"), N.parse(F.col("name"), "a/{b}/points/{p}")["p"]).collect()
    assert [tuple(r) for r in got] == [("1", "a/b", True, "1"), ("2", "a/b/points/1", False, None)]
    counts = lambda text: df.where(P.parse_filter(text)).count()
    assert [counts(t) for t in ("", "n > 5", 't = "x*"', "m = null", "m:*", "n = 5 OR n = 7 AND m = 3", "NOT n = 5", "-(n = 5)", 'name : "points/2"')] == [2, 1, 1, 1, 1, 1, 1, 1, 1]
    for bad in ("n >", "(n = 1", "= 3", "n ~ 3"):
        with pytest.raises(ValueError):
            P.parse_filter(bad)
    assert N.placeholders("a/{b}/c/{d}") == ["b", "d"]


def test_client(spark, tmp_path):
    client = connect(spark, f"file://{tmp_path}/store")
    c = client.create_collection("spaces/s").field("v", 4).create()
    assert c.insert_many([("a", {"v": [1, 0, 0, 0]}), ("b", {"v": [0, 1, 0, 0]}), ("c", {"v": [0.9, 0.1, 0, 0]})]) == 3
    hits = c.search("v", [1, 0, 0, 0], 3)
    assert [r.name[-1] for r in hits.rows()] == ["a", "c", "b"] and len(hits) == 3
    assert not c.insert("a", v=[0, 0, 1, 0]) and c.insert("d", v=[0, 0, 0, 2])
    c._store.seal("spaces/s")
    c.delete("a")
    assert [r.name[-1] for r in c.search("v", [1, 0, 0, 0], 2).rows()] == ["c", "b"]
    before = [(r.name, round(r.score, 6)) for r in c.search("v", [1, 1, 0, 0], 3).rows()]
    c._store.compact("spaces/s")
    assert [(r.name, round(r.score, 6)) for r in c.search("v", [1, 1, 0, 0], 3).rows()] == before
    assert c.get("a") is None and c.get("b").name == "spaces/s/points/b" and c.list().count() == 3
    assert c._store.vectors("spaces/s").agg(F.max("row")).first()[0] == 2
    for bad in ({"v": [1, 0]}, {"w": [1, 0, 0, 0]}, {"v": [math.nan, 0, 0, 0]}):
        with pytest.raises(ValueError):
            c.insert("bad", **bad)
    assert client.list_collections() == ["spaces/s"] and client.delete_collection("spaces/s") and client.list_collections() == []
    t = client.create_collection("spaces/t").text_field("text").create()
    t.add_texts(spark.createDataFrame([("1", "red green blue"), ("2", "one two three")], "id string, text string"), "text")
    assert t.search_text("text", "two three", 1).rows()[0].name.endswith("/2")


def test_stream_ingest(spark, tmp_path):
    from orrery.streaming.ingest import ingest as stream

    client = connect(spark, f"file://{tmp_path}/store")
    c = client.create_collection("s").field("v", 2).create()
    kind = "name string, span struct<start_ms:bigint,end_ms:bigint>, content_ref struct<uri:string,range_start:bigint,range_end:bigint,sha256:binary,inline_text:string>, vectors map<string,array<float>>"
    spark.createDataFrame([(f"s/points/{i}", None, None, {"v": [1.0, float(i)]}) for i in range(10)], kind).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = stream(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), client.store, "s", f"{tmp_path}/checkpoint", 5)
        assert q.awaitTermination(120)
    assert c.list().count() == 10 and all(s["sealed"] for s in client.store.manifest("s")["segments"])


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"a ""quoted"" one"\n ,"two\nlines"\n3,  \n')
    rows = ingest.read_csv(spark, str(tmp_path / "a.csv")).withColumn("n", F.monotonically_increasing_id())
    assert [tuple(r) for r in ingest.csv_points(rows, "id", "text", "n").collect()] == [("1", 'a "quoted" one'), ("row-2", "two\nlines")]
    assert ingest.csv_points(rows, "id", "none", "n").count() == 0
    x = np.arange(12, dtype="<f4").reshape(3, 4)
    data = b"".join(np.int32(4).tobytes() + r.tobytes() for r in x)
    (tmp_path / "b.fvecs").write_bytes(data)
    assert [r.vec for r in ingest.read_vectors(spark, str(tmp_path / "b.fvecs")).orderBy("row").collect()] == x.tolist()
    (tmp_path / "c.fvecs").write_bytes(data[:-1])
    with pytest.raises(Exception, match="inside a record"):
        ingest.read_vectors(spark, str(tmp_path / "c.fvecs")).collect()
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq\td\t1\nq\te\t0\n")
    assert [tuple(r) for r in ingest.read_judgements(spark, str(tmp_path / "q.tsv")).collect()] == [("q", "d", 1)]


def test_schema_and_tenancy(spark):
    kind = "point_type string, field string, dim int, metric string, model string"
    old = spark.createDataFrame([("t", "a", 4, "dot", "m"), ("t", "b", 4, "dot", "")], kind)
    assert schema.verdict(schema.compare(old, old)) == "identical"
    assert schema.verdict(schema.compare(old, old.union(spark.createDataFrame([("t", "c", 4, "dot", "")], kind)))) == "additive"
    assert schema.verdict(schema.compare(old, old.where("field = 'a'"))) == "breaking"
    with pytest.raises(ValueError):
        schema.Collection("c", (schema.VectorField("a", 4), schema.VectorField("a", 4)))
    now = F.lit("2020-01-01").cast("timestamp")
    empty = spark.createDataFrame([], "name string, display_name string, created_at timestamp, updated_at timestamp, deleted_at timestamp, expires_at timestamp")
    rows = tenancy.create(empty, "organizations/a/spaces/s", "S", now)
    gone = tenancy.soft_delete(rows, F.lit(True), now)
    twice = tenancy.soft_delete(gone, F.lit(True), F.lit("2021-01-01").cast("timestamp"))
    assert twice.first().expires_at.isoformat() == "2020-01-31T00:00:00"
    assert tenancy.children(twice, "organizations/a", "spaces").count() == 0 and tenancy.children(tenancy.undelete(twice, F.lit(True)), "organizations/a", "spaces").count() == 1
    with pytest.raises(NotImplementedError):
        tenancy.create(empty, "x", "x", now, "vault")


def test_laws(spark, corpus):
    rows, queries = corpus
    rnd = random.Random(3)
    whole = flat.batch_topk(rows, queries, 10, "dot")
    part = rnd.randrange(2, 5)
    parts = [flat.batch_topk(rows.where(F.col("row") % part == i), queries, 10, "dot").withColumn("source", F.lit(str(i))).drop("rank") for i in range(part)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    assert as_set(flat.merge_sources(both, 10, "dot", "row")) == as_set(whole)
    plan = store.compaction_plan(spark.createDataFrame([(1, 100, 50), (2, 100, 1), (3, 0, 0)], "id long, rows long, deleted long"))
    assert [(r.id, r.reason) for r in plan.collect()] == [(1, "tombstones")]


@pytest.mark.parametrize("kind", ["flat", "ivf", "ivfpq", "hnsw", "int8", "f16", "binary", "pq"])
def test_declared_indexes(spark, tmp_path, kind):
    client = connect(spark, f"file://{tmp_path}/store")
    c = client.create_collection("s").field("v", 8, "cosine", kind).create()
    x = clustered(330, 8, 4, 6)
    c.insert_many([(f"p{i:03d}", {"v": v.tolist()}) for i, v in enumerate(x[:300])])
    c._store.build_index("s", "v")
    c.insert_many([(f"q{i:03d}", {"v": v.tolist()}) for i, v in enumerate(x[300:])])
    c.delete("p007", "p013")
    left = [i for i in range(330) if i not in (7, 13)]
    hits = 0
    for i in (7, 50, 310):
        want = sorted(left, key=lambda j: -float(x[i] @ x[j]))[:5]
        got = [int(r.name[-3:]) + 300 * (r.name[-4] == "q") for r in c.search("v", x[i].tolist(), 5).rows()]
        assert len(got) == 5 and not {7, 13} & set(got)
        hits += len(set(got) & set(want))
    assert hits >= (15 if kind == "flat" else 12)
    few = spark.createDataFrame([("s/points/p020",), ("s/points/p021",)], "name string")
    assert {r.name[-3:] for r in c.search("v", x[7].tolist(), 5, few).rows()} == {"020", "021"}


def test_edge_tables(spark):
    from orrery.sources import edges

    kind = "src string, edge_type string, dst string, weight double, seq int"
    old = spark.createDataFrame([("a", "T", "b", 1.0, 1), ("a", "T", "c", 1.0, 1)], kind)
    new = edges.upsert(old, spark.createDataFrame([("a", "T", "b", 2.0, 2)], kind))
    assert [(r.dst, r.weight) for r in edges.listed(new, "weight > 0", "dst desc").collect()] == [("c", 1.0), ("b", 2.0)]
    assert edges.delete(new, old.where("dst = 'b'")).count() == 1
    bad = spark.createDataFrame([("a", "T\0", "b", 1.0, 1), ("", "T", "b", 1.0, 1), ("a", "T", "b", 1.0, 1)], kind)
    assert edges.faults(bad).count() == 2
