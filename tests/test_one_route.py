"""Results that do not depend on the size of a side: models, tags, searches; distance ranking against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from corpusflow.functions.scan import running_sum
from corpusflow.operators import extract, geo, textmodel

TEXTS = [(1, "the house and the garden"), (1, "das Haus und der Garten"), (None, "the garden"), (None, "der Garten"), (2, None), (2, "12 34"), (3, "the house and the garden")]


@pytest.fixture(scope="module")
def model(spark):
    rows = [("en", "the house and the garden of the king"), ("de", "das Haus und der Garten des Königs"), ("fr", "la maison et le jardin du roi")]
    return textmodel.train_nb(spark.createDataFrame(rows, "label string, text string"))


def rounded(df):
    return sorted((str(r[0]), r["tokens"], [round(x, 9) for x in r["scores"]], list(r["seen"]), list(r["word_seen"])) for r in df.collect())


def test_repeated_keys_score_alike_for_models_of_any_size(spark, model, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.lit("xx").alias("language"))
    small, tagged = rounded(textmodel.score_nb(docs, model)), sorted(map(str, extract.tag_language(chunks, model).collect()))
    decided = sorted(map(str, textmodel.decide_language(docs, model).select("doc_id", "code", "reason").collect()))
    assert len(small) == 5 and len(tagged) == len(TEXTS) == len(decided)
    monkeypatch.setattr(textmodel, "BROADCAST_BYTES", 0)
    assert rounded(textmodel.score_nb(docs, model)) == small
    assert sorted(map(str, extract.tag_language(chunks, model).collect())) == tagged
    assert sorted(map(str, textmodel.decide_language(docs, model).select("doc_id", "code", "reason").collect())) == decided


def test_sums_over_a_sparse_order_with_ties(spark):
    random.seed(2)
    data = [(k, random.choice([0, 1, 10**12]) * random.randrange(1000), i, 1) for k in ("a", None) for i in range(200)]
    df = spark.createDataFrame(data, "k string, o long, tie long, v long")
    found = running_sum(df, ["k"], ["o", "tie"], "v", "x", 60).collect()
    for k in ("a", None):
        mine = sorted((r.o, r.tie, r.x) for r in found if r.k == k)
        assert [x for _, _, x in mine] == list(range(1, 201))


def test_distance_rank_needs_no_pairs(spark):
    """Ranks and verdicts from bounded candidates equal those from scores of every intent and tenant; many tenants share a place."""
    random.seed(3)
    spots = [(47.26 + random.random() * 0.6, 11.39 + random.random() * 2) for _ in range(12)]
    rows = [(f"t{i:03d}", *spots[i % 12], i % 5 == 0, i % 11 != 0) for i in range(150)]
    tenants = spark.createDataFrame(rows, "tenant_id string, lat double, lng double, has_lift boolean, is_active boolean")
    texts = ["nähe zu Innsbruck und Seefeld", "nahe Salzburg-Stadt mit Skilift vor dem Hotel", "Which hotel is closest to Zell am See?", "close to Wien with sauna",
             "near a skigebiet, close to Mondsee", "Hotel near Kaprun or near a ski area", "unweit Innsbruck, pool und Skigebiet", "ok", "close to Innsbruck"]
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, text string")
    asked = geo.prepare(geo.parse_geo(queries)).cache()
    hits = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("i")).select(
        "query_id", F.format_string("t%03d", (F.xxhash64("query_id", "i") % 75 + 75).cast("int")).alias("tenant_id"), F.col("i").alias("text_rank"))
    every = geo.distance_scores(asked, tenants, hits).cache()
    found = asked.filter("is_geo")
    scores = geo.candidate_scores(found, tenants, hits, 4).cache()
    verdict = sorted(map(tuple, geo.conflicts(every).collect()))
    assert sorted(map(tuple, geo.verdicts(found, tenants, scores).collect())) == verdict and len(verdict) >= 6
    for n in (1, 4):
        conflict = geo.conflicts(every)
        assert sorted(map(str, geo._branches(every, conflict, n).collect())) == sorted(map(str, geo._branches(scores, conflict, n).collect()))
    assert scores.count() < every.count() / 2
