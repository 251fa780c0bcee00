"""Stateful streams: out-of-order steps over restarts, state that expires with the watermark."""

import datetime as dt

import pytest

from corpusflow.session import shared_folder
from corpusflow.streaming import jobs
from corpusflow.streaming.sessions import CONSTRAINTS, FEATURES, fold_sessions

SCHEMA = "run_id string, agent string, kind string, phase string, elapsed_ms long, duration_ms double, status string, ts timestamp"


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def step(run, phase, ms, hours, duration=None, status="ok"):
    return (run, "a", "tool" if phase == "end" else "call", phase, ms, duration, status, at(hours))


@pytest.fixture
def feed(spark):
    """Each call appends rows to the source and runs the query from its checkpoint to the end."""
    source, out, checkpoint = (shared_folder(spark, x) for x in ("in", "out", "state"))

    def run(rows, schema, build):
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(df.schema).parquet(source))
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    return run


def test_durations_over_restarts_and_expiry(feed):
    build = lambda s: jobs.live_durations(s, "ts", ttl_hours=2.0, watermark="1 minute")
    feed([step("r", "start", 30, 0.2), step("r", "start", 10, 0.1), step("r", "end", 50, 0.3), step("old", "start", 5, 0.0)], SCHEMA, build)
    # the second end meets the second start, which an earlier run of the query has kept; a given duration counts
    feed([step("r", "end", 90, 0.4, 7.0, "error")], SCHEMA, build)
    # the watermark passes 2 hours after both keys' last steps: a later end of "old" finds no start, and counting begins anew
    feed([step("far", "start", 1, 9.0)], SCHEMA, build)
    feed([step("far", "end", 4, 9.1)], SCHEMA, build)
    feed([step("old", "end", 500, 9.2), step("r", "start", 100, 9.2), step("r", "end", 103, 9.3)], SCHEMA, build)
    found = feed([step("zzz", "start", 0, 9.4)], SCHEMA, build)
    assert sorted(map(tuple, found.collect())) == [("far", "a", 1, "tool", 3, "ok"), ("r", "a", 1, "tool", 3, "ok"), ("r", "a", 1, "tool", 40, "ok"), ("r", "a", 2, "tool", 7, "error")]


def test_sessions_expire(spark, feed):
    from corpusflow.plans.q_streams import session_features

    features = session_features(spark, "/root/testdata/sf0.001")
    first = [r.asDict() for r in features.collect()]
    session = min(r["session_id"] for r in first)
    turns = sorted((r for r in first if r["session_id"] == session), key=lambda r: r["turn"])
    assert len(turns) >= 2
    names = ["session_id", "turn", *CONSTRAINTS, *FEATURES]
    schema = features.select(*names).schema.add("ts", "timestamp")
    rows = lambda some, hours, **more: [tuple({**r, **more}.get(n) for n in names) + (at(hours),) for r in some]
    build = lambda s: fold_sessions(s, "ts", ttl_hours=1.0, watermark="1 minute")
    feed(rows(turns[:1], 0.0, region="tirol"), schema, build)
    kept = feed(rows(turns[1:2], 0.1, region=None), schema, build)
    assert {r.region_state for r in kept.collect()} == {"tirol"}
    feed(rows(turns[:1], 5.0, session_id="other", region=None), schema, build)
    feed(rows(turns[:1], 5.1, session_id="other", region=None, turn=50), schema, build)
    last = feed(rows(turns[1:2], 5.2, turn=99, region=None), schema, build)
    assert [r.region_state for r in last.where(f"session_id = '{session}' AND turn = 99").collect()] == [None]
