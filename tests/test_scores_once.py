"""Texts are scored once, words are looked up together, and a large model lends blocks its word features only."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators import textmodel as tm
from corpusflow.operators.extract import feature_hash_embedder
from tests.test_blocks import scored

TEXTS = ["the house and the garden of the king", "das Haus und der Garten des Königs", None, "", "12 !", "x", "a b", "A.", "e\u0301te\u0301 \u0301ab \U0001d49ebc",
         "the \U0001d49ebc zzz", "Donaudampfschifffahrtsgesellschaft der Garten!", "\uac00\ub098 \uffee\u0915\u093f of", "the garden " * 500 + " ".join(f"w{chr(97 + i % 26) * (i % 9)}" for i in range(300))]


@pytest.fixture(scope="module")
def model(spark):
    rows = [("good", t) for t in TEXTS[::2]] + [("bad", t) for t in TEXTS[1::2]]
    return tm.train_binary_nb(spark.createDataFrame(rows, "label string, text string"), "good", "bad")


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS * 5)), "doc_id long, text string").repartition(3)


def test_a_condition_on_the_scores_does_not_score_again(spark, model):
    found = tm.is_positive(tm.score_binary_nb(docs(spark), model, "good", "bad"), "good")
    assert 0 < found.count() < 65
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert tm.score_nb(docs(spark), model)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_words_looked_up_together_have_the_sums_of_single_features():
    words = sorted({w for t in TEXTS if t for w in t.lower().split()})
    grams = sorted({g for w in words[::2] + words[-3:] for g in tx.word_features(w)})
    rng = np.random.default_rng(3)
    likelihoods = np.where(rng.random((len(grams), 3)) < 0.3, np.nan, rng.normal(size=(len(grams), 3)))
    unseen, at = [-4.0, -5.0, -6.0], {g: i for i, g in enumerate(grams)}

    def alone(text):
        out = np.zeros(11)
        for word in text.split():
            features = tx.word_features(word)
            found = [at[g] for g in features if g in at]
            known = ~np.isnan(likelihoods[found])
            whole = likelihoods[at[features[0]]] if features[0].startswith("w:") and features[0] in at else np.full(3, np.nan)
            out += np.concatenate([[len(features), features[0].startswith("w:")], np.where(known, likelihoods[found] - unseen, 0).sum(0), known.sum(0), ~np.isnan(whole)])
        return out

    texts = [(t or "").lower() for t in TEXTS]
    scorer = tm._WordScorer(grams, likelihoods, unseen)
    scorer.TOGETHER, scorer.CACHED = 7, 40
    np.testing.assert_allclose(list(scorer.totals(texts * 2)), [alone(t) for t in texts * 2], atol=1e-9)
    short = [i for i, g in enumerate(grams) if not g.startswith("w:")]
    long = [i for i, g in enumerate(grams) if g.startswith("w:")]
    lent = tm._WordScorer(tm._Grams([grams[i] for i in short]), likelihoods[short + long], unseen, [grams[i] for i in long])
    np.testing.assert_allclose(list(lent.totals(texts)), [alone(t) for t in texts], atol=1e-9)


def test_a_block_asks_a_large_model_for_word_features_only(spark, model, monkeypatch):
    small = scored(tm.score_nb(docs(spark), model))
    short = model.counts.filter("ngram NOT LIKE 'w:%'").count()
    monkeypatch.setattr(tm, "BROADCAST_BYTES", short * (48 + 9 * 2))
    assert not model.is_small()
    asked, words = spark.sparkContext.accumulator(0), tm._block_words

    def counted(batches):
        for found in words(batches):
            asked.add(len(found))
            yield found

    monkeypatch.setattr(tm, "_block_words", counted)
    assert scored(tm.score_nb(docs(spark), model)) == small
    distinct = len({w for t in TEXTS if t for w in t.lower().split()})
    assert 0 < asked.value <= 3 * distinct


def test_weights_and_letter_tests(spark):
    texts = TEXTS + ["abcdefghijk", "abcdefghijkl", "abcdefghijkl.", "a1b2" * 12 + "c.", "a1b2" * 12 + ".", "1234567890123."]
    count = tx.letter_count(F.col("text"))
    complete = F.substring("text", -1, 1).isin(".", "?", "!", "\u0589", "\u2026")
    weight = F.when(count < 12, 0.2).when(complete & (count >= 25), 1.0).when(complete, 0.7).otherwise(0.35)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in df.select("text", tm.example_weight(F.col("text")).alias("a"), weight.alias("b"), tx.has_letters(F.col("text"), 2).alias("c"), (count >= 2).alias("d")).collect():
        assert row.a == row.b and row.c == row.d, row


def test_training_sums_are_those_of_single_features(spark, model):
    want = {}
    for i, text in enumerate(TEXTS):
        for word in re.split(r"[\W\d_]+", (text or "").lower().replace("\u0301", "ZMARK")):
            for gram in tx.word_features(word.replace("ZMARK", "\u0301").lower()) if word else []:
                want[gram] = want.get(gram, [0, 0])
                want[gram][i % 2] += 1
    at = [model.labels.index("good"), model.labels.index("bad")]
    found = {r["ngram"]: [r[f"c{at[0]}"] or 0, r[f"c{at[1]}"] or 0] for r in model.counts.collect()}
    plain = {g: n for g, n in want.items() if not set(g) & set("\u093f\uac00\ub098\u0915\uffee")}
    assert {g: found.get(g) for g in plain} == plain
    assert all(n is None or n > 0 for r in model.counts.collect() for n in r[1:])


def test_embedding_is_the_signed_sum_of_word_hashes():
    import xxhash

    texts = ["the house the", "", None, "Das Haus \u00e9t\u00e9 " * 9]
    want = np.zeros((4, 64))
    for row, text in enumerate(texts):
        for word in (text or "").lower().split():
            h = xxhash.xxh64_intdigest(word, 7)
            want[row, h % 64] += 1.0 if (h >> 32) & 1 else -1.0
    length = np.sqrt((want * want).sum(axis=1, keepdims=True))
    assert np.array_equal(feature_hash_embedder()(texts), want / np.where(length > 0, length, 1.0))
