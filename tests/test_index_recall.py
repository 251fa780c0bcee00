"""The registered index search finds nine tenths of the hits of a brute-force search."""

import numpy as np

from corpusflow.plans import q_retrieval
from corpusflow.plans.tables import vector_chunks, vector_queries

SF = "/root/testdata/sf0.01"


def unit(rows):
    m = np.array([r["embedding"] for r in rows], dtype=float)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_registered_search_recall(spark):
    queries = vector_queries(spark, SF).where("embedding is not null").select("query_id", "embedding").collect()
    chunks = vector_chunks(spark, SF).filter("is_active and embedding is not null").select("chunk_id", "embedding").orderBy("chunk_id").collect()
    scores = np.round(unit(queries) @ unit(chunks).T, 9)
    exact = set()
    for q, row in zip(queries, scores):
        best = np.argsort(-row, kind="stable")[:5]
        exact |= {(q["query_id"], chunks[i]["chunk_id"]) for i in best if row[i] >= q_retrieval.MIN_SCORE}
    found = {(r["query_id"], r["chunk_id"]) for r in q_retrieval.vs4_ivf_topk(spark, SF).collect()}
    print("recall", len(exact & found) / len(exact))
    assert len(exact & found) >= 0.9 * len(exact)
