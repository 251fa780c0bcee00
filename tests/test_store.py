"""Stored tables by key: what a batch reads and writes, odd keys, deletes; the key log of the ingest."""

import os
import re

import pytest
from pyspark.sql import functions as F

from corpusflow.sources import sinks, store
from corpusflow.streaming import jobs

SCHEMA = "chunk_id long, tenant_id string, content string, title string, embedding array<float>, crawled_at int, language string"


def chunks(spark, ids, word="old", at=1):
    rows = [(i, f"t{0 if i is None else i % 3}", f"{word} {i}", word, [1.0, 2.0], at, "de" if word == "old" else "en") for i in ids]
    return spark.createDataFrame(rows, SCHEMA)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def pruned(rows):
    """The scan is told the buckets."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return re.search(r"PartitionFilters: \[[^\]]*_bucket#\d+ (IN|=|INSET)", plan)


def test_small_batch_reads_and_writes_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "chunks")
    table = store.create_table(chunks(spark, range(1000)), path, ["chunk_id"], 16)
    before = files(path)
    assert len(before) == 16
    touched = store.merge_chunks(store.open_table(spark, path), chunks(spark, [7, 2000], "new", 2))
    assert 1 <= len(touched) <= 2
    after = files(path)
    assert {f for f in before if not any(f"_bucket={b}/" in f for b in touched)} <= after
    assert not [f for f in before & after if any(f"_bucket={b}/" in f for b in touched)]
    assert pruned(table.part(touched))
    one = table.lookup(chunks(spark, [7]))
    assert [(r.chunk_id, r.content, r.language) for r in one.collect()] == [(7, "new 7", "de")]


def test_equal_to_the_join_and_idempotent(spark, tmp_path):
    existing, incoming = chunks(spark, range(0, 300)), chunks(spark, range(150, 450), "new", 2)
    repeated = incoming.withColumn("v", F.lit(1)).unionByName(incoming.where("chunk_id % 5 = 0").withColumn("content", F.lit("late")).withColumn("v", F.lit(2)))
    table = store.create_table(existing, str(tmp_path / "c"), ["chunk_id"], 8)
    expected = sinks.upsert_chunks(existing, repeated, "v")
    for _ in range(2):
        store.merge_chunks(table, repeated, "v")
        assert table.read().columns == existing.columns
        assert sorted(map(str, table.read().collect())) == sorted(map(str, expected.collect()))


def test_odd_keys_and_batches(spark, tmp_path):
    table = store.create_table(chunks(spark, [1, None]), str(tmp_path / "c"), ["chunk_id"], 4)
    assert store.merge_chunks(table, chunks(spark, [])) == []
    # a null is a key like any other; columns that the batch lacks are null in new rows, columns that the table lacks are left out
    batch = chunks(spark, [None, 2, 2, 2], "new", 2).drop("language", "crawled_at").withColumn("extra", F.lit("x"))
    store.merge_chunks(table, batch)
    found = {r.chunk_id: r for r in table.read().collect()}
    assert table.read().count() == 3 and found[None].content == "new None" and found[None].language == "de"
    assert found[2].language is None and found[2].crawled_at is None and found[1].content == "old 1"
    two = store.create_table(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, _n int, _o string"), str(tmp_path / "t"), ["k", "_n"], 4)
    two.merge(spark.createDataFrame([("a", 2, "z"), ("b", None, "n")], "k string, _n int, _o string"), {"_o": "replace"})
    assert sorted(map(tuple, two.read().na.fill(-1).collect())) == [("a", 1, "x"), ("a", 2, "z"), ("b", -1, "n")]


def test_delete_empties_buckets(spark, tmp_path):
    table = store.create_table(chunks(spark, range(40)), str(tmp_path / "c"), ["chunk_id"], 8)
    table.delete(chunks(spark, range(1, 40)))
    assert [r.chunk_id for r in table.read().collect()] == [0] and len(files(table.path)) == 1
    store.merge_chunks(table, chunks(spark, [5, 6], "new", 2))
    assert sorted(r.chunk_id for r in store.open_table(spark, table.path).read().collect()) == [0, 5, 6]


@pytest.fixture
def page(spark):
    return lambda *urls: spark.createDataFrame([(u, f"<html><body><main>{'many words of ' + u + ' ' } {'text ' * 60}</main></body></html>") for u in urls], "url string, html string")


def test_ingest_reads_the_keys_of_its_buckets(spark, tmp_path, page):
    path = str(tmp_path / "chunks")
    jobs.ingest_batch(page(*[f"https://a.example.com/p{i}" for i in range(60)]), 0, path)
    log = f"{path}/_keys"
    keys = page("https://a.example.com/P3", "https://a.example.com/new").select(F.lit("a").alias("tenant_id"), F.lower("url").alias("_key"))
    keys = keys.withColumn("_bucket", store.bucket_of(["tenant_id", "_key"], jobs.KEY_BUCKETS))
    known = jobs._known_keys(spark, log, keys, 1)
    assert pruned(known) and known.select("_metadata.file_path").distinct().count() <= 2 < 30 < len(files(log))
    jobs.ingest_batch(page("https://a.example.com/P3", "https://a.example.com/new"), 1, path)
    jobs.ingest_batch(page("https://a.example.com/P3", "https://a.example.com/new"), 1, path)  # a repeated batch
    found = spark.read.parquet(path)
    assert found.count() == 61 and [r.source_url for r in found.where("batch_id = 1").collect()] == ["https://a.example.com/new"]
