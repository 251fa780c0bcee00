"""A model that workers cannot hold meets blocks of texts, not rows of words."""

from pyspark.sql import functions as F

from corpusflow.operators import textmodel


def scored(df):
    return sorted((r[0], r["tokens"], [round(x, 9) for x in r["scores"]], list(r["seen"]), list(r["word_seen"])) for r in df.collect())


def test_a_block_asks_once_for_each_feature(spark, monkeypatch):
    rows = [("en", "the house and the garden of the king"), ("de", "das Haus und der Garten des Königs")]
    model = textmodel.train_nb(spark.createDataFrame(rows, "label string, text string"))
    texts = [(i, text) for i, text in enumerate(["the garden der König " * 40, "das Haus", None, "12", "zzz qqq", "Garten " * 300] * 20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    small = scored(textmodel.score_nb(docs, model))
    assert len(small) == 80
    grams, counter = textmodel._block_grams, spark.sparkContext.accumulator(0)

    def counted(batches):
        for found in grams(batches):
            counter.add(len(found))
            yield found

    monkeypatch.setattr(textmodel, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(textmodel, "_block_grams", counted)
    assert scored(textmodel.score_nb(docs, model)) == small
    # 8 words have about 150 features, a block in each of 3 tasks; texts and their words would be over 300 rows before any feature
    assert 100 < counter.value <= 3 * 200
    plan = textmodel.score_nb_shuffled(docs.withColumn("n", F.monotonically_increasing_id()), model, "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
