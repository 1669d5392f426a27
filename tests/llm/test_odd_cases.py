"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns with names that operators use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import bottomk, lm, mixing, packing, quality, queries, simhash, suffixes, toxicity, warc
from orrery.llm.common import crc_of_id

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c"), (None, None), (4, "tie tie tie"), (5, "tie tie tie"), (5, "tie tie tie"), (6, LONG), (7, "one"), (8, "x" * 70_000)]
#: Names that the operators give to columns of their own.
CLASHES = "uid id node print root leaf home key keys size hash h bucket rounds times target source_key of_source threshold each data marks _data _marks _uid _id _slot _word _bits _in_doubt word n bin_group start length offset sketch range guest step score predicted held_out y x other_0 shard".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(i, t, "s1" if (i or 0) % 2 else None, "en", len(t or "")) for i, t in TEXTS], "doc_id long, text string, source string, lang string, n_chars long")
    return rows.select("*", *[F.lit(f"kept {c}").alias(c) for c in CLASHES]).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 0, 0, "c"), (4, 1, 0, "c"), (5, 0, 1, "c"), (6, 1, 0, "c"), (7, 1, None, "c"), (None, 1, 1, "c"), (9, 1, 1, "c")], "doc_id long, quality int, toxic int, x string")


def model(module):
    return lambda d, labels: module.with_scores(d, module.train(d, labels, F.lit(True)))


OPERATORS = {
    "packing": lambda d, _: packing.pack(d, queries.vocabulary("word_bpe_49k.json")).where("start = 0"),
    "simhash": lambda d, _: simhash.near_duplicates(d),
    "quality": model(quality),
    "toxicity": model(toxicity),
    "mixing": lambda d, _: mixing.mix(d),
    "lm": lambda d, _: lm.score(d, crc_of_id() % 10 == 0, queries.vocabulary("byte_bpe_multi_50k.tiktoken")),
    "suffixes": lambda d, _: suffixes.removals(d),
    "bottomk": lambda d, _: bottomk.edits(d),
    "warc": lambda d, _: warc.round_trip(d.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), *CLASHES)).withColumnRenamed("page_id", "doc_id"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, docs, labels, name):
    out = OPERATORS[name](docs, labels).collect()
    assert sorted(r.doc_id or -1 for r in out) == sorted(i or -1 for i, _ in TEXTS)
    assert OPERATORS[name](docs.limit(0), labels).count() == 0
    if name in ("simhash", "quality", "toxicity", "suffixes"):  # equal texts, equal answers
        same = [tuple(v for k, v in r.asDict().items() if k not in ("doc_id", "component_id")) for r in out if r.doc_id in (4, 5)]
        assert len(set(same)) == 1


def test_stages_keep_columns_of_any_name(spark, docs, tmp_path):
    docs.sparkSession.createDataFrame([(4, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert all(r[c] == f"kept {c}" for r in out.collect() for c in CLASHES)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
