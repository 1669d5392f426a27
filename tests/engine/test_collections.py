"""Blocks of queries, row numbers, log and recovery, pages, masks and tenants."""

import pytest
from pyspark.sql import functions as F

from orrery.client import BatchError, connect
from orrery.functions.filters import masked
from orrery.operators import approximate as A
from orrery.operators import flat
from orrery.sources import files, ingest, store


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(600).select(F.col("id").alias("row"), F.transform(F.array(*[F.lit(i) for i in range(8)]), lambda i: (F.pmod(F.xxhash64("id", i), F.lit(2001)) / 1000.0 - 1).cast("float")).alias("vec")).repartition(5).cache()


def answers(df):
    return sorted((r.query_id, r.rank, r.row) for r in df.collect())


def test_queries_in_blocks(spark, rows, monkeypatch):
    queries = rows.where("row % 7 = 0").select(F.col("row").alias("query_id"), "vec")
    whole = answers(flat.batch_topk(rows, queries, 4, "l2"))
    codes = A.encoded(rows, "f16")
    tiers = answers(A.two_tier(rows, codes, queries, 4, "f16", "l2"))
    monkeypatch.setattr(flat, "MOST_QUERIES", 20)
    assert answers(flat.batch_topk(rows, queries, 4, "l2")) == whole == tiers
    assert answers(A.two_tier(rows, codes, queries, 4, "f16", "l2")) == tiers
    assert flat.batch_topk(rows, queries.limit(0), 4, "l2").count() == 0


def test_row_numbers_are_dense_in_order(spark, rows):
    some = rows.select("row", F.when(F.col("row") % 3 == 0, "a").when(F.col("row") % 3 == 1, "b").alias("kind"))
    got = store.renumbered(some, F.col("row") % 5 != 0, ["row"], "kind").collect()
    for kind in ("a", "b", None):
        own = sorted((r.row, r.new_row) for r in got if r.kind == kind)
        assert [n for _, n in own] == list(range(len(own))) and all(r % 5 for r, _ in own)
    assert store.renumbered(some.limit(0), F.lit(True), ["row"]).count() == 0


def point(i, v):
    return (f"s/points/{i}", None, None, {"v": v})


def test_recovery_applies_whole_entries_and_drops_torn_ones(spark, tmp_path):
    from orrery.client import _POINT

    c = connect(spark, f"file://{tmp_path}/store").create_collection("s").field("v", 2, "dot").create()
    own = c._store
    own.log("s", spark.createDataFrame([point(1, [1.0, 0.0])], _POINT))
    torn = own.log("s", spark.createDataFrame([point(2, [1.0, 0.0])], _POINT))
    own.log("s", spark.createDataFrame([point(3, [1.0, 0.0])], _POINT))
    for f in (tmp_path / "store" / "s" / "log" / str(torn) / "rows").glob("*.parquet"):
        f.write_bytes(f.read_bytes()[:-20])  # cut short
    for f in (tmp_path / "store" / "s" / "log" / str(torn) / "rows").glob(".*.crc"):
        f.unlink()
    assert own.recover("s") == 1 and own.recover("s") == 0
    assert [r.name for r in own.points("s").collect()] == ["s/points/1"]
    assert c.insert("4", v=[0, 1]) and own.points("s").count() == 2


def test_batches_pages_and_tenants(spark, tmp_path):
    client = connect(spark, f"file://{tmp_path}/store")
    c = client.create_collection("s").field("v", 2, "dot", codec="int8").create()
    with pytest.raises(BatchError) as bad:
        c.insert_many([("a", {"v": [1, 0]}), ("b", {"v": [1, 0, 0]})])
    assert (bad.value.index, bad.value.written) == (1, 0) and c.list().count() == 0
    assert c.insert_many([(str(i), {"v": [1, i]}) for i in range(5)]) == 5
    first = c.search("v", [0, 1], 3)
    second = c.search("v", [0, 1], 3, page_token=first.next_page_token, mask="name")
    assert [r.name[-1] for r in first.rows()] == ["4", "3", "2"] and [r.name[-1] for r in second.rows()] == ["1", "0"]
    assert second.next_page_token == "" and second.frame.columns == ["name", "score", "rank", "source"] and first.stats == {"buffer": 5}
    with pytest.raises(ValueError):
        c.search("v", [0, 1], 3, page_token="bm8=")
    c._store.seal("s")
    one = spark.createDataFrame([(0, [0.0, 1.0])], "query_id long, vec array<double>")
    assert [r.score for r in c._store.search_coded("s", "v", one, 2).orderBy("rank").collect()] == [4.0, 3.0]
    assert c.insert_with_text("t", "a text", v=[0, 9]) and c.search("v", [0, 1], 1).rows()[0].content_ref.inline_text == "a text"
    client.create_tenant("organizations/a/spaces/x")
    with pytest.raises(FileExistsError):
        client.create_tenant("organizations/a/spaces/x")
    client.delete_tenant("organizations/a/spaces/x")
    assert client.list_tenants("organizations/a", "spaces") == [] and client.list_tenants("organizations/a", "spaces", True) == ["organizations/a/spaces/x"]


def test_masks_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, ("x", 2), "t")], "a int, b struct<c:string,d:int>, e string")
    assert masked(df, "").columns == ["a", "b", "e"] and masked(df, "e, b.d").first().asDict(True) == {"b": {"d": 2}, "e": "t"}
    assert masked(df, "b.d,b").first().asDict(True) == {"b": {"c": "x", "d": 2}}
    for bad in ("z", "b.z"):
        with pytest.raises(ValueError):
            masked(df, bad)
    with pytest.raises(ValueError):
        ingest.bulk_export(df, str(tmp_path), "xls")
    files.write_text(spark, f"file://{tmp_path}/a.txt", "one")
    with pytest.raises(FileExistsError):
        files.write_text(spark, f"file://{tmp_path}/a.txt", "two")
