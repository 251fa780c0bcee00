"""Registered streaming queries (ST) and their SQL twins; each stream runs over the whole table and ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import sessions as cs
from corpusflow.operators import turns as ct
from corpusflow.plans.q_corpus import SQL as CORPUS_SQL
from corpusflow.plans.q_tables import SQL as TABLES_SQL
from corpusflow.plans.q_tables import _steps
from corpusflow.plans.q_turns import _decided
from corpusflow.plans.tables import table, vector_tenants
from corpusflow.session import shared_folder
from corpusflow.streaming import jobs
from corpusflow.streaming.sessions import fold_sessions


def _replay(spark, df, name: str, order: str, build, slices: int = 3):
    """Feed the whole table to a stream in ``slices`` steps of the order column and return its output.

    Every step appends its rows to the source table, restarts the query from its checkpoint and
    lets it run to the end, so state and progress are recovered between the steps.
    """
    source, out, checkpoint = (shared_folder(spark, f"{name}-{part}") for part in ("in", "out", "state"))
    low, high = df.agg(F.min(order), F.max(order)).first()
    step = F.least(F.floor((F.col(order) - low) * slices / max(high - low + 1, 1)), F.lit(slices - 1))
    for number in range(slices):
        df.filter(step == number).write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(df.schema).parquet(source))
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def session_features(spark, sf):
    features = ct.language_features(_decided(spark, sf))
    tagged = ct.tag_turns(features.drop("multi", "deictic", "region"), vector_tenants(spark, sf))
    return tagged.select("session_id", F.col("turn").cast("long").alias("turn"), "region", "named_tenant", "named_name", "deictic", "multi", *cs.FEATURES)


def st1_session_stream(spark, sf):
    timed = session_features(spark, sf).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60))
    return _replay(spark, timed, "sessions", "turn", lambda stream: fold_sessions(stream, "ts")).select(
        "session_id", "turn", "language", "source", "locked", "region_state", "focus_tenant")


def st2_ingest_stream(spark, sf):
    source, path, checkpoint = (shared_folder(spark, f"ingest-{part}") for part in ("in", "chunks", "state"))
    pages = table(spark, sf, "pages").select("url", "html", (F.col("page_id") % 2).alias("part"))
    for part in (0, 1):  # the second step repeats half of the first one's pages
        (pages if part else pages.filter("part = 0")).write.mode("append").parquet(source)
        jobs.ingest_stream(spark.readStream.schema(pages.schema).parquet(source), path, checkpoint).awaitTermination()
    return spark.read.parquet(path).select("chunk_id", "tenant_id", "source_url", F.length("content").cast("long").alias("n"), "language")


def st3_rate_limit(spark, sf):
    events = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return jobs.rate_violations(events, window="1 hour", limit=1).select(
        "user_id", F.unix_seconds("window_start").alias("start"), "requests")


def st3_rate_limit_stream(spark, sf):
    events = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    # a last row far in the future moves the watermark past every window
    closing = events.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), "ts")
    rows = events.unionByName(closing).withColumn("second", F.unix_seconds("ts"))
    out = _replay(spark, rows, "violations", "second",
                  lambda stream: jobs.rate_violations(stream, window="1 hour", limit=1, watermark="1 hour"))
    return out.select("user_id", F.unix_seconds("window_start").alias("start"), "requests")


def st4_live_durations(spark, sf):
    return _replay(spark, _steps(spark, sf), "durations", "elapsed_ms", jobs.live_durations).select("run_id", "agent", "occurrence", "kind", "duration_ms", "status")


QUERIES = {f.__name__: f for f in (st1_session_stream, st2_ingest_stream, st3_rate_limit, st3_rate_limit_stream, st4_live_durations)}

_RATE = """SELECT user_id, epoch(date_trunc('hour', ts))::BIGINT AS start, count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 1"""
SQL = {
    "st2_ingest_stream": CORPUS_SQL["ex_extract_chunks"],
    "st3_rate_limit": _RATE,
    "st3_rate_limit_stream": _RATE,
    "st4_live_durations": TABLES_SQL["bi8_durations"].replace("FROM nth GROUP BY ALL", "FROM nth GROUP BY run_id, agent, occurrence HAVING count(*) = 2"),
}
