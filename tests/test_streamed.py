"""Many queries stay in blocks while the chunks pass by: the rows of a sliced search, and only the best leave a block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import vector
from corpusflow.operators import product, retrieve


@pytest.fixture(scope="module")
def sides(spark):
    """Queries and chunks with repeated rows and ids, copies, null groups, null and zero vectors; groups of very different sizes."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(900, 16)).astype("f4")
    base[100:160] = base[100]
    group = lambda i: None if i % 50 == 7 else "big" if i % 3 else f"t{i % 40}"
    vec = lambda i, x: None if i % 97 == 5 else [0.0] * 16 if i % 97 == 6 else x.tolist()
    chunks = [(i, group(i), vec(i, x)) for i, x in enumerate(base)] + [(i, group(i), vec(i, base[i])) for i in range(0, 900, 9)]
    queries = [(i, "t3", vec(i + 3, x)) for i, x in enumerate(base[:300] + 0.2)]
    types = "long, tenant_id string, embedding array<float>"
    return spark.createDataFrame(queries, f"query_id {types}").repartition(3), spark.createDataFrame(chunks, f"chunk_id {types}").repartition(5)


def rows(df):
    return sorted(map(str, df.collect()))


def both(monkeypatch, found):
    out = []
    for least in (1 << 40, 0):
        monkeypatch.setattr(retrieve, "STREAM_ROWS", least)
        out.append(rows(found()))
    return out


@pytest.mark.parametrize("twice", [False, True])
@pytest.mark.parametrize("limit", [None, 40])
def test_streamed_search_gives_the_rows_of_a_sliced_one(spark, sides, monkeypatch, limit, twice):
    queries, chunks = sides
    queries = queries.unionByName(queries.filter("query_id % 4 = 0")) if twice else queries
    monkeypatch.setattr(product, "PACK_ROWS", 70)
    monkeypatch.setattr(vector.StreamedBest, "TILE", 16)
    tenants = spark.createDataFrame([(f"t{i}",) for i in range(45)], "tenant_id string")
    sliced, streamed = both(monkeypatch, lambda: retrieve.search_all(queries, chunks, 3, 0.1, limit, 4, tenants))
    assert len(sliced) > 900 and streamed == sliced


def test_only_the_best_of_each_tenant_leave_a_block(sides, monkeypatch):
    queries, chunks = sides
    monkeypatch.setattr(retrieve, "STREAM_ROWS", 0)
    hits, done = retrieve._topk(queries, chunks, 200, 0.0, "all", "tenant_id", 1000, 1 << 20, 64, 2)
    assert done and hits.groupBy("query_id", F.coalesce("tenant_id", F.lit("-"))).count().agg(F.max("count")).first()[0] == 2
    # a query that comes twice shares the candidates between its rows, which a block cannot know
    assert not retrieve._topk(queries.unionByName(queries), chunks, 200, 0.0, "all", "tenant_id", 1000, 1 << 20, 64, 2)[1]
