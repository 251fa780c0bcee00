"""The byte network: gradients, pooling over whole texts, held-out accuracy, odd rows."""

import numpy as np
import pytest

from corpusflow.llm import langid

SF = "/root/testdata/sf0.01"


def test_gradients():
    model = langid.BiGRU(["a", "b", "c"], hidden=4)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    rng = np.random.default_rng(0)
    windows, langs = rng.integers(0, 256, (5, 20)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    grads = model.gradients(windows, langs)[1]
    for name, w in model.w.items():
        for at in (np.unravel_index(np.abs(grads[name]).argmax(), w.shape), (0,) * w.ndim):
            value, sides = w[at], []
            for step in (1e-4, -1e-4):
                w[at] = value + step
                sides.append(model.gradients(windows, langs)[0])
            w[at] = value
            assert grads[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-4, abs=1e-6)


def test_pool_counts_each_byte_once():
    model = langid.BiGRU(["a", "b"])
    n = langid.WINDOW
    for size in (1, n - 1, n, n + 1, 3 * n, 3 * n + 5, langid.BATCH * n + 7):
        raw = bytes(i * 31 % 251 for i in range(size))
        want = np.zeros(2)
        if size <= n:
            p = model.label(np.frombuffer(raw.rjust(n), np.uint8)[None])
            want = p[:, n - size:, 0].sum(axis=1)
        else:
            for start in range(0, size - n, n):
                want += model.label(np.frombuffer(raw[start:start + n], np.uint8)[None])[:, :, 0].sum(axis=1)
            last = (size - 1) % n + 1
            want += model.label(np.frombuffer(raw[-n:], np.uint8)[None])[:, n - last:, 0].sum(axis=1)
        got = model.pool([raw, b"x"])[0]
        assert got == pytest.approx(want / size, abs=1e-5)
        assert got.sum() == pytest.approx(1, abs=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 150 and (rows["lang"] == rows["lang_pred"]).mean() > 0.97
    assert rows["score"].between(0, 1).all()


def test_odd_rows(spark):
    rows = [(i, t, l) for i in range(40) for t, l in (("the house is big and the garden green " * 3, "en"), ("das haus ist gross und der garten " * 3, "de"))]
    odd = [(None, None, "en"), (500, "", "de"), (501, "12 %% 34", "en"), (502, "a", None), (503, "the house " * 40_000, None), (503, "the house " * 40_000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS tag", "3 AS rank")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    of = {r.doc_id: r for r in got}
    assert {of[k].lang_pred for k in (None, 500, 501)} == {"und"} and of[None].held_out is False
    assert of[502].lang_pred in ("en", "de") and of[503].lang_pred == "en" and 0.5 < of[503].score <= 1
    assert langid.identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs["lang"].substr(9, 0)).where("lang IS NULL")).collect()} <= {"und"}
