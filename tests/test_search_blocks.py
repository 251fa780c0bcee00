"""A vector search holds some scores and hands its hits on in parts; blocks of rows are bounded by rows and bytes."""

import numpy as np
import pandas as pd

from corpusflow.functions import vector
from corpusflow.operators import product


def side(key, n, seed):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({key: np.arange(n), "grp": [f"t{i % 4}" for i in range(n)], "embedding": list(rng.normal(size=(n, 8)))})


def test_hits_come_in_parts(monkeypatch):
    small, big = side("query_id", 300, 1), side("chunk_id", 500, 2)
    for mode, k in (("all", 20), ("each", 3), ("own", 5)):
        whole = pd.concat(vector.topk_search(k, 0.1, mode)(small)(big))
        with monkeypatch.context() as m:
            m.setattr(vector, "CELLS", 4_000)
            m.setattr(vector, "HITS", 200)
            parts = list(vector.topk_search(k, 0.1, mode)(small)(big))
        assert len(parts) > 1 and max(map(len, parts)) <= 200 + k * 40
        order = ["query_id", "grp", "chunk_id"]
        pd.testing.assert_frame_equal(pd.concat(parts).sort_values(order, ignore_index=True), whole.sort_values(order, ignore_index=True))


def test_blocks_of_rows(monkeypatch):
    batches = [side("chunk_id", n, 3) for n in (10, 0, 25, 1)]
    blocks = list(product._blocks(iter(batches), 16))
    assert [len(b) for b in blocks] == [16, 16, 4]
    assert list(pd.concat(blocks)["chunk_id"]) == list(pd.concat(batches)["chunk_id"])
    monkeypatch.setattr(product, "BLOCK_BYTES", 8 * 8 * 5)
    assert max(len(b) for b in product._blocks(iter(batches), 16)) == 5
