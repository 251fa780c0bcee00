"""Kneser-Ney toxicity: probabilities against a plain formula, held-out accuracy, odd rows."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from corpusflow.llm import toxicity

SF = "/root/testdata/sf0.1"


def counted(words):
    grams, n = np.unique(toxicity._grams(words)[0], return_counts=True)
    return dict(zip(grams.tolist(), n.tolist()))


def test_evidence_is_a_difference_of_kneser_ney_likelihoods():
    words = [[b"good", b"day", b"goods", b"gold", b"day"], [b"goat", b"bad", b"bad", b"\xc3\xa9t\xc3\xa9"]]
    counts = [counted(w) for w in words]
    frame = pd.concat([pd.DataFrame({"gram": list(c), "toxic": y, "n": list(c.values())}) for y, c in enumerate(counts)])
    model = toxicity.Model(frame)

    def gram_of(text):
        return int.from_bytes(text, "big")

    def texts(word):
        padded = b" " * (toxicity.ORDER - 1) + word + b" "
        return [padded[i:i + toxicity.ORDER] for i in range(len(padded) - toxicity.ORDER + 1)]

    every = {t for c in words for w in c for t in texts(w)}
    assert {gram_of(t) for t in every} == set(counts[0]) | set(counts[1])

    def shared(t):
        if not t:
            return 1 / 256
        k = len(t)
        kinds = {x[-k - 1:] for x in every}
        n = sum(x[1:] == t for x in kinds)
        same = [x for x in kinds if x[1:-1] == t[:-1]]
        follow = len({x[-1:] for x in same})
        return (max(n - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * follow * shared(t[1:])) / len(same)

    def likelihood(y, t):
        mine = [x for w in words[y] for x in texts(w)]
        same = [x for x in mine if x[:-1] == t[:-1]]
        if not same:
            return shared(t[1:])
        return (max(mine.count(t) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(set(same)) * shared(t[1:])) / len(same)

    for word in {w for c in words for w in c}:
        want = sum(np.log(likelihood(1, t) / likelihood(0, t)) for t in texts(word))
        assert model.word_evidence([word])[0] == pytest.approx(want)
    assert model.word_evidence([b"zzz"])[0] == pytest.approx(np.log(1), abs=2)


def test_words():
    assert toxicity.words_of("You IDIOT!!! a-b 12,5 Été") == [b"you", b"idiot", b"a", b"b", b"00", b"0", "été".encode()]
    assert toxicity.words_of(None) == toxicity.words_of("%% \n") == []


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic, ordinary = rows[rows["toxic"] == 1], rows[rows["toxic"] == 0]
    assert len(toxic) > 100 and toxic["predicted"].mean() > 0.7
    assert ordinary["predicted"].mean() < 0.005
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.7) == (rows["predicted"] == 1)).all()


def test_odd_rows(spark):
    bad = [(i, f"you are an idiot and a moron number {i}", 1) for i in range(60)]
    good = [(i, f"what a lovely day in the garden number {i}", 0) for i in range(60, 160)]
    labels = spark.createDataFrame([(i, y, 9) for i, _, y in bad + good] + [(None, 1, 9), (3, 0, 9), (999, 1, 9), (70, None, 9)],
                                   "doc_id long, toxic int, text int")
    odd = [(None, "what an idiot"), (200, None), (201, ""), (202, "idiot " * 30_000), (3, "idiot"), (3, "idiot")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in bad + good] + odd, "doc_id long, text string").selectExpr("*", "1 AS toxic", "2 AS score")
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == 166
    of = {r.doc_id: r for r in rows}
    assert of[200].score == of[201].score and of[200].predicted == 0
    assert of[5].predicted == 1 and of[100].predicted == 0 and of[None].held_out is False
    kept = toxicity.keep_ordinary(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(60, 160)) | {200, 201}
    empty = docs.where("false")
    assert toxicity.classify(empty, labels).count() == 0
    assert {r.score for r in toxicity.classify(docs, labels.where("toxic = 0")).collect()} == {0.0}


def test_memory_of_a_batch_is_bounded():
    """8 MB of text, as a worker gets it at once, also as one text: the same counts and evidence, and no arrays of the whole batch."""
    words = [f"wort{i % 977}x{i % 31}" for i in range(800_000)]
    texts = [" ".join(words[:400_000]), None, "", *(" ".join(words[i:i + 400]) for i in range(400_000, 800_000, 400))]
    every, times = np.unique(words, return_counts=True)
    plain = {}
    for w, k in zip(every.tolist(), times.tolist()):
        for gram, n in counted(toxicity.words_of(w)).items():
            plain[gram] = plain.get(gram, 0) + n * k
    tracemalloc.start()
    grams, n = toxicity.gram_counts(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dict(zip(grams.tolist(), n.tolist())) == plain and grams.tolist() == sorted(plain)
    assert peak < 60 << 20  # the words of the one long text; arrays of all n-grams took over 400 MB
    assert [len(x) for x in toxicity.gram_counts([None, ""])] == [0, 0]


def test_blocks_change_no_features(monkeypatch):
    frame = pd.concat([pd.DataFrame({"gram": list(c), "toxic": y, "n": list(c.values())})
                       for y, c in enumerate([counted([b"good", b"day"]), counted([b"bad", b"goat"])])])
    texts = ["good goat day bad", None, "", "bad " * 300, "é unknown words here", "day"]
    whole = toxicity.Model(frame).features(texts)
    monkeypatch.setattr(toxicity, "LETTERS_AT_ONCE", 1)
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 1)
    assert (toxicity.Model(frame).features(texts) == whole).all()
    assert toxicity.Model(frame).features([]).shape == (0, len(toxicity.FEATURES))
