import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from orrery.llm import warc

PAGES = [(1, "http://a/1", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://a/3 x\r\ny", None), (4, "u", ""), (5, "u", "x" * 200_000), (6, "u", "<p>é</p>"), (None, "u", "lonely\r\n\r\nWARC/1.1\r\n")]


def want(pages, least=0):
    out = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == data]
        keeper = max((p for p in same if p is not None), default=None)
        again = len(data) >= least and len(same) > 1 and page_id != keeper
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page_id, len(data), digest, "revisit" if again else "response", keeper if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, record_type string")
    got = [tuple(r) for r in warc.round_trip(df, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == want(PAGES, least)
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_predicates_and_contents(spark, tmp_path, compression, monkeypatch):
    warc.register(spark)
    rows = [("response", f"urn:page:{i}", f"http://h/{i}", "2000-01-01T00:00:00Z", None, f"payload {i} ".encode() * (i * 50)) for i in range(40)]
    path = f"file://{tmp_path}/w"
    df = spark.createDataFrame(rows, warc.TO_WRITE).coalesce(1)
    df.write.format("warc").option("compression", compression).option("file_bytes", 4_000).mode("append").save(path)
    assert len(list((tmp_path / "w").iterdir())) > 1
    read = spark.read.format("warc").load(path)
    assert sorted((r.record_id, bytes(r.payload)) for r in read.collect()) == sorted((r[1], r[5]) for r in rows)
    some = read.where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://h/3"))
    assert some.count() == 11
    assert read.where(F.col("record_id").isin("urn:page:7", "urn:page:9")).count() == 2
    heads = spark.read.format("warc").option("content", "headers").load(path)
    assert heads.where("payload IS NULL").count() == 40
    assert heads.where("record_type = 'revisit'").count() == 0


def test_unwanted_blocks_are_not_decoded(monkeypatch):
    data = b"".join(warc.gzip_member(warc.build("response", f"r{i}", None, "d", None, b"z" * 3_000_000 + b"%d" % i)) for i in range(5))
    calls = []
    real = warc.zlib.decompressobj

    class Counting:
        def __init__(self, *a):
            self.inner = real(*a)

        def decompress(self, *a):
            out = self.inner.decompress(*a)
            calls.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.inner, name)

    assert len(gzip.decompress(data)) > 15_000_000
    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    got = list(warc.records(File(data), lambda h: h["warc-record-id"] == "<r3>", True))
    assert len(got) == 1 and got[0][1].endswith(b"3") and sum(calls) < 3_200_000
    assert len(list(warc.records(File(data), lambda h: True, False))) == 5
    plain = gzip.compress(warc.build("response", "a", None, "d", None, b"one")) + gzip.compress(warc.build("response", "b", None, "d", None, b"two"))
    assert [b.endswith((b"one", b"two")) for _, b in warc.records(File(plain), lambda h: True, True)] == [True, True]
    with pytest.raises(ValueError):
        list(warc.records(File(data[:-5]), lambda h: True, True))
