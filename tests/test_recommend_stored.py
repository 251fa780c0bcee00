"""The batch of recommendations embeds each chunk once, however many steps read the chunks."""

import numpy as np

from corpusflow.operators import extract
from corpusflow.plans import q_recommend

SF = "/root/testdata/sf0.001"


def test_each_chunk_is_embedded_once(spark, monkeypatch):
    seen, make = spark.sparkContext.accumulator(0), extract.feature_hash_embedder

    def counted():
        call = make()

        def embed(texts):
            seen.add(len(texts))
            return np.asarray(call(texts))

        return embed

    monkeypatch.setattr(extract, "feature_hash_embedder", counted)
    rows = q_recommend.rc15_recommend_batch(spark, SF).count()
    documents, turns = (spark.read.parquet(f"{SF}/{name}.parquet").count() for name in ("documents", "conversations"))
    assert 0 < rows <= turns
    # the documents once; the questions, a part of the turns, where they are stored
    assert documents < seen.value <= documents + turns
