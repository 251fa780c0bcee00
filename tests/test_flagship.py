"""The flagship gives every tenant its best chunks, without a cap on candidates."""

from corpusflow.plans import q_retrieval, registry


def test_flagship_is_exact(spark, monkeypatch):
    chunks = [(f"a{i:03}", "a", [1.0, 0.0], True) for i in range(300)] + [("0", "b", [1.0, 0.0], True)]
    chunks += [(f"b{i}", "b", [1.0, 0.1 * i], True) for i in (1, 2, 3)]
    made = {
        "vector_chunks": spark.createDataFrame(chunks, "chunk_id string, tenant_id string, embedding array<float>, is_active boolean"),
        "vector_queries": spark.createDataFrame([(1, "a", [1.0, 0.0])], "query_id long, tenant_id string, embedding array<float>"),
        "vector_tenants": spark.createDataFrame([("a", True), ("b", True)], "tenant_id string, is_active boolean"),
    }
    for name, df in made.items():
        monkeypatch.setattr(q_retrieval, name, lambda *_, df=df: df)
    rows = registry.QUERIES[registry.FLAGSHIP](spark, "").collect()
    assert sorted(r.chunk_id for r in rows) == ["0", "a000", "a001", "a002", "b1", "b2"]
