"""The offline embedder and what a write costs."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.client import connect
from orrery.sources import files, ingest


def test_embedder_by_hand(spark):
    texts = ["One two, two THREE", "", None, "!!", "x_1 é y " * 700, *(f"word{i} and {i * i}" for i in range(600))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for dim in (16, 64):
        for r in ingest.embed(rows, dim=dim).collect():
            if r.text is None:
                assert r.vec is None
                continue
            sums = [0.0] * dim
            for w in re.split(r"[^a-zA-Z_0-9]+", r.text.lower()):
                if w:
                    h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                    sums[h % dim] += 1 if h >> 20 & 1 else -1
            n = math.sqrt(sum(x * x for x in sums))
            assert r.vec == [float(np.float32(x / n if n else x)) for x in sums]


def test_points_of_a_write_are_made_once_and_a_faulty_batch_leaves_nothing(spark, tmp_path):
    c = connect(spark, f"file://{tmp_path}/store").create_collection("s").text_field("text", 8).create()
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        made.add(1)
        return text

    texts = spark.range(40).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    assert c.add_texts(texts.withColumn("text", seen("text")), "text") == 40
    assert made.value == 40  # twice before: for the check and for the log
    with pytest.raises(ValueError, match="foreign parent"):
        c.add_texts(texts.withColumn("id", F.concat(F.lit("a/"), "id")), "text")
    assert c.list().count() == 40 and not [n for n in files.names(spark, f"file://{tmp_path}/store/s/log") if n.isdigit()]
    with pytest.raises(KeyError):
        c._store.append("none", spark.createDataFrame([], "name string"))
