"""Equivalences: both product routes, cut and uncut folds, exact and approximate search, repeated writes."""

import random

from pyspark.sql import functions as F

from corpusflow.functions.policy import empty_state, step
from corpusflow.functions.scan import running_last, running_sum
from corpusflow.operators import corpuscheck, retrieve, sessions, turns
from corpusflow.plans import q_retrieval, q_turns
from corpusflow.plans.tables import turns as turn_table
from corpusflow.plans.tables import vector_chunks, vector_queries, vector_tenants
from corpusflow.sources import sinks
from corpusflow.streaming import jobs

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_search_blocks_equal_broadcast(spark):
    queries, chunks = vector_queries(spark, SF), vector_chunks(spark, SF)
    for call in (lambda **o: retrieve.search(queries, chunks, 3, 0.2, **o),
                 lambda **o: retrieve.search_all(queries, chunks, 2, 0.2, candidate_limit=None, **o),
                 lambda **o: retrieve.search_all(queries, chunks, 1, 0.2, candidate_limit=7, refill=0, **o)):
        assert rows(call()) == rows(call(max_rows=10, block_rows=100))


def test_all_tenants_without_limit_equals_search_per_tenant(spark):
    queries, chunks = vector_queries(spark, SF), vector_chunks(spark, SF)
    each = retrieve.search_all(queries, chunks, 3, 0.2, candidate_limit=None)
    tenants = vector_tenants(spark, SF).select("tenant_id")
    asked = queries.drop("tenant_id").withColumn("tenant_id", F.explode(F.array(*[F.lit(r[0]) for r in tenants.collect()])))
    assert rows(each) == rows(retrieve.search(asked, chunks, 3, 0.2))


def test_keyword_blocks_equal_broadcast(spark):
    queries, chunks = q_retrieval._keyword_inputs(spark, SF)
    assert rows(retrieve.keyword_search(queries, chunks, 2, 0.5)) == rows(retrieve.keyword_search(queries, chunks, 2, 0.5, max_rows=3))


def test_name_blocks_equal_broadcast(spark):
    keyed = turn_table(spark, SF).withColumn("text_id", F.concat_ws(":", "session_id", "turn"))
    tenants = vector_tenants(spark, SF)
    assert rows(turns.match_tenant(keyed, tenants)) == rows(turns.match_tenant(keyed, tenants, max_rows=1, block_rows=4))


def test_approximate_recall(spark):
    queries, chunks = vector_queries(spark, SF), vector_chunks(spark, SF).filter("is_active")
    model, indexed = retrieve.build_ivf(chunks, 8)
    exact = retrieve.search_ivf(queries, model, indexed, 5, 0.0, nprobe=8)
    near = retrieve.search_ivf(queries, model, indexed, 5, 0.0, nprobe=4)
    found = retrieve.recall(exact, near).first()
    assert found["expected"] == 5 * queries.count() and found["recall"] > 0.6


def test_running_values_do_not_depend_on_segments(spark):
    random.seed(1)
    data = [(f"k{i % 3}", i, random.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(data, "k string, o long, v long")
    for inclusive in (True, False):
        assert rows(running_last(df, ["k"], "o", {"x": "v"}, inclusive, 7)) == rows(running_last(df, ["k"], "o", {"x": "v"}, inclusive, 1000))
    filled = df.fillna(0)
    assert rows(running_sum(filled, ["k"], "o", "v", "x", 5)) == rows(running_sum(filled, ["k"], "o", "v", "x", 1000))


def _random_turns(seed):
    random.seed(seed)
    codes = ["de", "en", "fr", "ca", "rm"]
    out = []
    for s in range(6):
        for t in range(40):
            top = random.sample(codes, 3)
            out.append((f"s{s}", t, f"x{t}", None if random.random() < .9 else "en", random.random() < .05, random.random() < .1, random.random() < .3,
                        random.choice([None, None, None, "it"]), random.random() < .1, top[:random.randint(0, 2)], top[:random.randint(0, 3)],
                        random.choice([None, top[0]]), random.random() < .3, random.random() < .1))
    return out


def test_cut_language_fold_equals_plain_loop(spark):
    data = _random_turns(5)
    schema = ("session_id string, turn long, text string, _hint string, marker boolean, shared boolean, cue boolean, choice string, "
              "affirmative boolean, close array<string>, sticky array<string>, code string, unknown boolean, unrecognized boolean")
    df = spark.createDataFrame(data, schema)
    initial = spark.createDataFrame([("s1", "fr", True, None, None), ("s2", None, False, ["de", "en"], "older")],
                                    "session_id string, locked string, first_unambiguous boolean, pending_codes array<string>, pending_query string")
    expected = []
    for s in range(6):
        state = empty_state()
        if s == 1:
            state.update(locked="fr", first_unambiguous=True)
        if s == 2:
            state.update(pending_codes=["de", "en"], pending_query="older")
        for row in sorted(r for r in data if r[0] == f"s{s}"):
            state, language, source, text = step(state, sessions._turn_of(row[2:]))
            expected.append((row[0], row[1], language, source, text, state["locked"], state["first_unambiguous"]))
    for segment in (3, 7, 4096):
        got = sorted((tuple(r) for r in sessions.fold_language(df, initial, segment).collect()), key=lambda r: r[:2])
        assert got == sorted(expected, key=lambda r: r[:2])


def test_constraint_fold_does_not_depend_on_segments(spark):
    tagged = q_turns._tagged(spark, SF)
    key = lambda df: sorted(map(str, df.select("session_id", "turn", "region_state", "focus_tenant").collect()))
    assert key(sessions.fold_constraints(tagged, segment=2)) == key(sessions.fold_constraints(tagged))


def test_template_swaps_with_hot_prefix(spark):
    hot = "This is the very same beginning of many texts "
    data = [(i, "b", hot + ("x" * (i % 5)) + str(i)) for i in range(60)] + [(100, "b", "z" * 45), (101, "c", hot + "1")]
    df = spark.createDataFrame(data, "text_id long, block string, text string")

    def lcp(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    expected = set()
    for i, b, t in data:
        need = max(40, -(-len(t) * 55 // 100))
        if any(i != j and b == c and lcp(t, u) >= need for j, c, u in data):
            expected.add(i)
    assert {r["text_id"] for r in corpuscheck.template_swaps(df).collect()} == expected


def test_upsert_is_idempotent(spark):
    schema = "chunk_id string, tenant_id string, title string, content string, language string, embedding array<float>, crawled_at int"
    old = spark.createDataFrame([("a", "t", "T", "c", "de", None, 1)], schema)
    new = spark.createDataFrame([("a", "x", "N", "n", "en", [1.0], 2), ("b", "x", "N", "m", "en", None, 2)], schema)
    once = sinks.upsert_chunks(old, new)
    assert rows(once) == rows(sinks.upsert_chunks(once, new)) == [("a", "t", "N", "n", "de", [1.0], 2), ("b", "x", "N", "m", "en", None, 2)]


def test_snapshot_keeps_the_first_copy(spark, tmp_path):
    path = str(tmp_path / "copy")
    sinks.snapshot(spark.range(3), path)
    sinks.snapshot(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_repeated_ingest_batch_changes_nothing(spark, tmp_path):
    page = "<html><title>T</title><body><article>" + "words and more words " * 10 + "</article></body></html>"
    pages = spark.createDataFrame([("https://a.example.com/1", page), ("https://a.example.com/2", page)], "url string, html string")
    path = str(tmp_path / "chunks")
    for batch, data in ((0, pages.limit(1)), (1, pages), (1, pages)):
        jobs.ingest_batch(data, batch, path)
    assert spark.read.parquet(path).count() == 2


def test_session_stream_equals_batch_folds(spark):
    from corpusflow.plans import q_streams

    streamed = q_streams.st1_session_stream(spark, SF).drop("region_state", "focus_tenant")
    batch = q_turns.cs1_language_fold(spark, SF).drop("first_unambiguous")
    key = lambda df: sorted(map(str, df.select("session_id", "turn", "language", "source", "locked").collect()))
    assert key(streamed) == key(batch)
