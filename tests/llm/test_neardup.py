"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest

from corpusflow.llm import neardup
from tests.llm.test_simhash import roots

SF = "/root/testdata/sf0.001"


def brute(rows, threshold):
    def fine(r):
        return r[1] is not None and r[2] and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2])

    pairs, n = [], [0] * len(rows)
    vectors = [np.array(r[2], dtype=np.float64) if fine(r) else None for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            x, y = vectors[i], vectors[j]
            if x is None or y is None or rows[i][1] != rows[j][1] or len(x) != len(y):
                continue
            if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                pairs.append((i, j))
                n[i] += 1
                n[j] += 1
    root = roots(range(len(rows)), pairs)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    return sorted((str(r[0]), n[i], str(least.get(root[i])), r[0] == least.get(root[i])) for i, r in enumerate(rows))


def got(df, **options):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in neardup.near_duplicates(df, **options).collect())


@pytest.mark.parametrize("tile", [7, 64, 2048])
def test_crowded_vectors(spark, tile):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1, None):
        for centre in rng.normal(size=(6, 12)):
            rows += [[0, label, (centre + rng.normal(size=12) * s).tolist()] for s in rng.uniform(0, 0.35, 25)]
    rows += [[0, 1, [float("nan")] + [1.0] * 11], [0, 1, [0.0] * 12], [0, 1, [None] + [1.0] * 11], [0, 1, None], [0, 1, []], [0, 1, [1.0, 2.0]],
             [0, 1, [2.0, 4.0]], [0, 0, [float("inf")] * 12]]
    rows += [list(rows[3]), list(rows[3]), list(rows[40])]
    for i, r in enumerate(rows):
        r[0] = i * 7 % 1000
    rows[5][0], rows[60][0], rows[9][0] = None, None, rows[10][0]
    rows = [(a, b, None if c is None else [None if x is None else float(np.float32(x)) for x in c]) for a, b, c in rows]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 AS node", "'x' AS strip")
    assert got(df, tile=tile) == brute(rows, 0.98)


def test_given_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "label", "embedding").collect()]
    assert got(df, tile=50) == brute(rows, 0.98)


def test_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert got(df) == []


def test_tiny_and_huge_vectors(spark):
    rows = [(1, 0, [1e-200, 0.0]), (2, 0, [3.0, 1e-3]), (3, 0, [1e300, 1e290]), (4, 0, [0.0, 5e-324]), (5, 0, [1e308, -1e308]), (6, 0, [1e-310, -1e-310]), (7, 0, [0.0, 0.0]),
            (8, 0, [2e-200, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(vectors).collect()}
    assert found == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 8: (3, 1, False), 4: (0, 4, True), 5: (1, 5, True), 6: (1, 5, False), 7: (0, 7, True)}


def test_many_repeats_of_one_vector(spark):
    rows = [(i, 1, [1.0, 2.0]) for i in range(10_000)] + [(20_000, 1, [1.0, 2.01])]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    assert [tuple(r) for r in found.groupBy("n_links", "component_id").count().collect()] == [(10_000, 0, 10_001)]
