"""Registered queries of stored, key-partitioned tables; the twins are those of the joins they replace."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.plans.q_tables import SQL as TABLES_SQL
from corpusflow.plans.q_tables import _as_of, _chunk_versions, _tenant_versions
from corpusflow.plans.tables import table
from corpusflow.session import shared_folder
from corpusflow.sources import store


def _stored(spark, rows, key: str, name: str, buckets: int = 16):
    return store.create_table(rows, shared_folder(spark, name), [key], buckets)


def snk1_store_upsert(spark, sf):
    """The chunk upsert on a stored table, in two batches of which the second repeats the first."""
    existing, incoming = _chunk_versions(spark, sf)
    chunks = _stored(spark, existing, "chunk_id", "chunks")
    store.merge_chunks(chunks, incoming.filter("chunk_id % 4 = 0"), "v")
    store.merge_chunks(store.open_table(spark, chunks.path), incoming, "v")
    return chunks.read().select("chunk_id", "tenant_id", "title", "content", "language", "is_active", "crawled_at")


def snk2_store_upsert(spark, sf):
    existing, incoming = _tenant_versions(spark, sf)
    tenants = _stored(spark, existing, "tenant_id", "tenants")
    store.merge_tenants(tenants, incoming, _as_of())
    return tenants.read().select("tenant_id", "name", "api_key", F.round("latitude", 4).alias("latitude"),
                                 F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


def snk3_store_sessions(spark, sf):
    """Sessions as they grow: each turn is a batch that replaces the messages of its sessions, the last two in one batch."""
    turns = table(spark, sf, "conversations").select(
        F.concat(F.lit("s"), "conv_id").alias("session_id"), F.concat(F.lit("t"), F.col("turn") % 7).alias("tenant_id"),
        F.length("text").cast("long").alias("messages"), "turn", (F.col("turn") % 3).alias("batch"))
    sessions = _stored(spark, turns.where("turn = 0").select("session_id", "tenant_id", "messages"), "session_id", "sessions")
    last = turns.groupBy("session_id", "batch").agg(F.max_by(F.struct("tenant_id", "messages"), "turn").alias("v"))
    for batch in range(3):
        store.merge_sessions(sessions, last.where(F.col("batch") == batch).select("session_id", "v.*"))
    return sessions.read()


def snk8_store_delete(spark, sf):
    """Rows of inactive chunks go by their keys."""
    existing, _ = _chunk_versions(spark, sf)
    chunks = _stored(spark, existing, "chunk_id", "chunks", 4)
    chunks.delete(chunks.read().where("NOT is_active"))
    return chunks.read().select("chunk_id", "tenant_id", "content")


def snk13_store_load(spark, sf):
    existing, incoming = _chunk_versions(spark, sf)
    nr = F.col("chunk_id")
    incoming = incoming.withColumn("tenant_id", F.concat(F.lit("t"), nr % 14)) \
        .withColumn("language", F.when(nr % 6 == 0, "").otherwise("en"))
    chunks = _stored(spark, existing, "chunk_id", "chunks")
    store.load_stored_chunks(chunks, incoming, existing.select("tenant_id").distinct(), "v")
    return chunks.read().select("chunk_id", "tenant_id", "content", "language")


QUERIES = {f.__name__: f for f in (snk1_store_upsert, snk2_store_upsert, snk3_store_sessions, snk8_store_delete, snk13_store_load)}

SQL = {
    "snk1_store_upsert": TABLES_SQL["snk1_upsert"],
    "snk2_store_upsert": TABLES_SQL["snk2_upsert_coalesce"],
    "snk3_store_sessions": """WITH t AS (SELECT 's' || conv_id AS session_id, turn, turn % 3 AS batch, length(text) AS messages FROM conversations),
        l AS (SELECT session_id, batch, max_by(messages, turn) AS messages, max(turn) AS turn FROM t GROUP BY ALL),
        f AS (SELECT session_id, max_by(messages, batch) AS messages, min_by(turn, batch) AS first FROM l GROUP BY ALL),
        z AS (SELECT session_id FROM t WHERE turn = 0)
        SELECT session_id, CASE WHEN session_id IN (SELECT session_id FROM z) THEN 't0' ELSE 't' || (first % 7) END AS tenant_id, messages FROM f""",
    "snk8_store_delete": """SELECT vec_id AS chunk_id, 't' || label AS tenant_id, 'old ' || vec_id AS content FROM embeddings
        WHERE vec_id % 3 <> 0 AND vec_id % 13 <> 5""",
    "snk13_store_load": TABLES_SQL["snk13_bulk_load"],
}
