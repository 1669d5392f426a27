"""Queries of the parts that searches are made of: quantisers, their parameters, distances.

Where SQL has no such part, a query states laws that its answers must keep, and how many of them held.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import approximate as A
from orrery.operators import quantize as Q
from orrery.plans.registry import _CENTROIDS, _DOT, _L2, _Q0, _label_means, first_vector, query, table, vectors


@query(f"WITH {_CENTROIDS}, a AS (SELECT vec_id AS row, embedding::DOUBLE[] AS v, c, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(embedding::DOUBLE[], c), cs.label) AS n FROM embeddings, cs) SELECT row, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: i * (v[i] - c[i]))), 6) AS total FROM a WHERE n = 1")
def ivf_residuals(spark, sf):
    """What a vector differs from its centroid, in a sum that tells the components apart."""
    means = _label_means(spark, sf)
    table_ = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(means)], "list int, c array<double>")
    joined = A.assign(vectors(spark, sf), means).join(F.broadcast(table_), "list").select("row", F.zip_with("vec", "c", lambda v, c: v.cast("double") - c).alias("left"))
    return joined.select("row", F.round(F.aggregate(F.transform("left", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT n::BIGINT AS n, greatest(1, least(n, round_even(sqrt(n), 0)))::BIGINT AS lists, greatest(greatest(1, least(n, round_even(sqrt(n), 0)))::BIGINT // 16, 1)::BIGINT AS probes FROM (SELECT o_orderkey AS n FROM orders)")
def ivf_parameters(spark, sf):
    n = F.col("o_orderkey")
    lists = F.greatest(F.lit(1), F.least(n, F.bround(F.sqrt(n.cast("double")), 0).cast("long")))
    own = table(spark, sf, "orders").select(n.cast("long").alias("n"), lists.cast("long").alias("lists"))
    return own.withColumn("probes", F.greatest(F.floor(F.col("lists") / 16), F.lit(1)).cast("long"))


@query("SELECT 5::BIGINT AS checks, 5::BIGINT AS held")
def ivf_parameter_function(spark, sf):
    """The functions that a build uses, at the ends of their range."""
    held = [A.lists_for(0) == 1, A.lists_for(1) == 1, A.lists_for(500) == 22, A.probes_for(15) == 1, A.probes_for(256) == 16]
    return spark.createDataFrame([(5, sum(held))], "checks long, held long")


@query("""SELECT k::BIGINT AS k, ratio, greatest(k, CASE WHEN ratio IS NULL THEN greatest(k * 4, 32) ELSE greatest(ceil(k * greatest(2.0, least(20.0, 0.75 * ratio)))::BIGINT, 8 * floor(greatest(2.0, least(20.0, 0.75 * ratio)))::BIGINT, 32) END)::BIGINT AS candidates
    FROM (SELECT unnest(range(1, 60, 7)) AS k), (SELECT unnest([NULL, 1.0, 4.0, 8.0, 32.0, 64.0]::DOUBLE[]) AS ratio)""")
def over_fetch_policy(spark, sf):
    rows = [(k, r, V.over_fetch(k, r)) for k in range(1, 60, 7) for r in (None, 1.0, 4.0, 8.0, 32.0, 64.0)]
    return spark.createDataFrame(rows, "k long, ratio double, candidates long")


@query(f"WITH {_Q0} SELECT vec_id AS row, round(-({_DOT}), 6) AS dot, round({_L2}, 6) AS l2 FROM embeddings, q0")
def score_as_distance(spark, sf):
    q, v = V.literal(first_vector(spark, sf)), F.col("vec")
    return vectors(spark, sf).select("row", F.round(V.distance(V.score(v, q, "dot"), "dot"), 6).alias("dot"), F.abs(F.round(V.distance(V.score(v, q, "l2"), "l2"), 6)).alias("l2"))


@query("SELECT 4::BIGINT AS checks, 4::BIGINT AS held")
def kmeans_laws(spark, sf):
    """Each row is with its nearest centroid, centroids are means of their rows, the same seed gives the same, and no row of one cluster each errs."""
    import numpy as np

    x = Q.sample(vectors(spark, sf), most=500)
    c = Q.kmeans(x, 12, 100)
    own = Q.nearest(x, c)
    truth = np.argmin(((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2), axis=1)
    means = all(np.allclose(c[k], x[own == k].mean(axis=0)) for k in range(len(c)) if (own == k).any())
    held = [bool((own == truth).all()), means, np.array_equal(c, Q.kmeans(x, 12, 100)), np.allclose(np.sort(Q.kmeans(x[:5], 9), axis=0), np.sort(x[:5], axis=0))]
    return spark.createDataFrame([(4, sum(held))], "checks long, held long")


@query("SELECT vec_id AS row, TRUE AS table_equals_decoded, TRUE AS read_again FROM embeddings")
def pq_codes(spark, sf):
    """Scores by a query's table equal those of decoded rows, by every metric, and a codebook written and read again codes alike."""
    import numpy as np

    rows, q = vectors(spark, sf), np.array(first_vector(spark, sf))
    book = Q.train_pq(Q.sample(rows), 8, 5)
    again = Q.Codebook.load(book.dump())
    shared = spark.sparkContext.broadcast((book, again, q))

    def held(batches):
        import pyarrow as pa

        book, again, q = shared.value
        for batch in batches:
            x = Q.matrix(batch.column(1))
            codes = book.encode(x)
            back = book.decode(codes)
            same = np.isclose(book.scores(codes, q, "dot"), back @ q) & np.isclose(book.scores(codes, q, "l2"), ((back - q) ** 2).sum(axis=1))
            alike = np.isclose(((again.decode(again.encode(x)) - x) ** 2).sum(axis=1), ((back - x) ** 2).sum(axis=1), atol=1e-5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same), pa.array(alike)], names=["row", "table_equals_decoded", "read_again"])

    return rows.select("row", "vec").mapInArrow(held, "row long, table_equals_decoded boolean, read_again boolean")
