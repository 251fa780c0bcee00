"""The stored vector index: recall against the rows read, exactness, partition pruning, odd vectors; the keyword index."""

import numpy as np
from pyspark.sql import functions as F

from corpusflow.operators import ivf, retrieve
from corpusflow.plans.tables import vector_chunks, vector_queries

SF = "/root/testdata/sf0.01"


def exact(queries, chunks, k=5, floor=0.2):
    return retrieve.search_all(queries, chunks.withColumn("tenant_id", F.lit("all")), k, floor)


def test_recall_at_a_fifth_of_the_rows(spark, tmp_path):
    queries, chunks = vector_queries(spark, SF), vector_chunks(spark, SF).filter("is_active")
    index = ivf.build_index(chunks, str(tmp_path / "index"))
    hits = ivf.search_index(queries, index, 5, 0.2)
    assert retrieve.recall(exact(queries, chunks), hits).first()["recall"] >= 0.9
    assert ivf.share_read(queries, index, 0.2).first()["share"] <= 0.2
    everything = ivf.search_index(queries, index, 5, 0.2, read_share=ivf.TABLES).drop("rn")
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, exact(queries, chunks).select("query_id", "chunk_id", "score").collect()))


def clustered(spark, n=3000, groups=60):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(groups, 32))
    rows = [(i, "t", (centres[i % groups] + rng.normal(size=32) * 0.3).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, tenant_id string, embedding array<double>")


def test_a_query_reads_a_few_parts_and_lists_below_the_score_are_left_out(spark, tmp_path):
    chunks = clustered(spark)
    index = ivf.build_index(chunks, str(tmp_path / "index"), tables=2)
    one = chunks.where("chunk_id = 7").selectExpr("chunk_id AS query_id", "embedding")
    parts = ivf.probes(one, index, 0.8, 2.0).first()["parts"]
    assert 0 < len(parts) < index.rows().select("part").distinct().count() / 4
    plan = index.rows().where(F.col("part").isin(parts))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan
    # the bound of the angles loses nothing
    queries = chunks.where("chunk_id % 29 = 0").selectExpr("chunk_id AS query_id", "embedding")
    found = ivf.search_index(queries, index, 4, 0.8, read_share=2.0).drop("rn")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact(queries, chunks, 4, 0.8).select("query_id", "chunk_id", "score").collect()))
    assert ivf.share_read(queries, index, 0.8, 2.0).first()["share"] < 0.2


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [-1.0, 0.0]), (6, [1.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").withColumn("tbl", F.lit(9)).drop("tbl")
    index = ivf.build_index(chunks, str(tmp_path / "index"), tables=2)
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id long, embedding array<double>")
    assert [tuple(r)[:2] for r in ivf.search_index(queries, index, 2, 0.5, 2.0).orderBy("rn").collect()] == [(1, 1), (1, 4)]
    ivf.build_index(chunks.where("false"), str(tmp_path / "none"))
    none = ivf.open_index(spark, str(tmp_path / "none"))
    assert ivf.search_index(queries, none, 2, 0.5).count() == 0


def test_keyword_postings_count_repeated_terms_and_titles(spark):
    queries = spark.createDataFrame([(1, "red red blue"), (2, ""), (3, None), (4, "Green"), (5, "absent word")], "query_id int, query string")
    chunks = spark.createDataFrame([(1, "t", "a RED house", "x"), (2, "t", "blue", "redder"), (3, "u", None, None), (4, "u", "evergreen", "Green")],
                                   "chunk_id int, tenant_id string, content string, title string")
    found = {(r.query_id, r.chunk_id): round(r.score, 6) for r in retrieve.keyword_search(queries, chunks, 3, 0.3).collect()}
    assert found == {(1, 1): round(2 / 3, 6), (1, 2): 1.0, (4, 4): 1.0}
