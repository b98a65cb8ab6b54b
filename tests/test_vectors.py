"""Vector search by blocks and by inverted lists against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import vectors as vec


def rows(n=300, width=8, seed=2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, width))
    x = centers[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, width))
    out = [(i, int(rng.integers(0, 9)), [float(v) for v in x[i]]) for i in range(n)]
    return [*out, (900, 1, out[3][2]), (901, 2, out[3][2]), (902, 3, None), (903, 3, [0.0] * width), (904, 3, [1.0] * 3), (905, 4, [1.0, None] * 4), (None, 1, out[1][2])]


def brute(given, queries, k, threshold):
    unit = {i: (own, np.array(v) / np.linalg.norm(v)) for i, own, v in given if i is not None and v and None not in v and len(v) == 8 and any(v)}
    out = []
    for q, not_own, v in queries:
        if v and None not in v and any(v):
            s = sorted(((-float(u @ (np.array(v) / np.linalg.norm(v))), i, own) for i, (own, u) in unit.items() if own != not_own))
            out += [(q, i, own, round(-x, 9)) for x, i, own in s[:k] if -x >= threshold]
    return sorted(out)


@pytest.mark.parametrize("block", [16, vec.ROWS])
def test_nearest_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vec, "ROWS", block)
    monkeypatch.setattr(vec, "QUERIES", block)
    given = rows()
    queries = [(i, own, v) for i, own, v in given if i is not None and i % 10 < 4]
    v = spark.createDataFrame(given, "id bigint, own bigint, embedding array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id bigint, not_own bigint, embedding array<double>")
    found = vec.nearest(v, q, 4, 0.2)
    # Of equal vectors scores are equal up to the last bits, so ranks are compared by rounded scores.
    key = lambda r: (r[0], r[3])
    assert sorted(map(key, ((r[0], r[1], r[2], round(r[3], 9)) for r in found.collect()))) == sorted(map(key, brute(given, queries, 4, 0.2)))
    each = {(r["query_id"], r["own"]): r["score"] for r in vec.best_of_each(v, q.withColumn("not_own", F.col("query_id")), 0.2).collect()}
    best = {}
    for a, b, own, s in brute([(i, i, x) for i, _, x in given], [(i, i, x) for i, _, x in queries], 10_000, 0.2):
        product = next(p for i, p, _ in given if i == b)
        best[a, product] = max(s, best.get((a, product), -1))
    assert each.keys() == best.keys() and all(abs(each[k] - best[k]) < 1e-8 for k in best)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_products_by_their_mean(spark):
    given = [(1, 1, [1.0, 0.0]), (2, 1, [0.8, 0.2]), (3, 2, [1.0, 0.1]), (4, 2, [0.0, 1.0]), (5, 3, [-1.0, 0.0])]
    found = vec.similar_products(spark.createDataFrame(given, "id bigint, own bigint, embedding array<double>"), 2, 0.5).collect()
    assert sorted((r["product_id"], r["similar_id"]) for r in found) == [(1, 2), (2, 1)]


def test_inverted_lists_find_most(spark, tmp_path, monkeypatch):
    given = [r for r in rows(3000, 8, 5)]
    v = spark.createDataFrame(given, "id bigint, own bigint, embedding array<double>").repartition(4)
    q = v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.lit(-1).alias("not_own"), "embedding")
    monkeypatch.setattr(vec, "ROWS", 200)
    vec.write_lists(v, f"{tmp_path}/l", 32)
    assert spark.read.parquet(f"{tmp_path}/l/rows").count() == len(given)
    exact = {(r[0], r[1]) for r in vec.nearest(v, q, 10).collect()}
    found = {(r[0], r[1]) for r in vec.search_lists(spark, f"{tmp_path}/l", q, 10).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    assert {(r[0], r[1]) for r in vec.search_lists(spark, f"{tmp_path}/l", q, 10, probes=32).collect()} == exact


def test_empty_vectors(spark, tmp_path):
    v = spark.createDataFrame([], "id bigint, own bigint, embedding array<double>")
    q = v.select(F.col("id").alias("query_id"), F.col("own").alias("not_own"), "embedding")
    assert vec.nearest(v, q, 3).count() == 0
    vec.write_lists(v, f"{tmp_path}/l")
    assert vec.search_lists(spark, f"{tmp_path}/l", q, 3).count() == 0
