"""The neighbour search goes on until it has converged, however poor its start."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabqa.llm import ann

N = 4000


@pytest.fixture(scope="module")
def vectors(spark):
    v = np.random.default_rng(1).standard_normal((N, 10))
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")


def test_poor_starts_do_not_cost_recall(vectors):
    v, df = vectors
    p = ann.AnnParams(k=10, forest=2, leaf=6, sample=4, beam=16, rescore=16)
    got = {}
    for r in ann.nearest(df, F.col("id") % 40 == 0, p).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, N, 40):
        s = u @ u[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits / 500 >= 0.95, hits / 500


def test_tiny_and_huge_vectors_have_their_cosines(vectors):
    spark = vectors[1].sparkSession
    rows = [(0, [1e-200, 0.0]), (50, [1e200, 1e200]), (1, [0.0, 5e-324]), (2, [1.0, 1.0]), (3, [1e308, -1e308]), (4, [-1e-160, 1e-170])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    half = round(0.5**0.5, 9)
    assert sorted(got[0]) == [(1, 2, half), (2, 3, half), (3, 50, half), (4, 1, 0.0), (5, 4, -1.0)]
    assert sorted(got[50])[:3] == [(1, 2, 1.0), (2, 0, half), (3, 1, half)]


def test_searches_without_an_end_are_errors(vectors):
    with pytest.raises(RuntimeError, match="still"):
        ann.nearest(vectors[1], F.col("id") == 0, ann.AnnParams(k=10, forest=2, leaf=6, sample=4, guard=2)).collect()
