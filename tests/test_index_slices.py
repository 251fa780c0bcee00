"""A search without a bound on the rows looks at one table; one with a bound sends the lists of one table at a time."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corpusflow.functions import vector
from corpusflow.operators import ivf, product, retrieve
from tests.test_streamed import both, rows, sides  # noqa: F401


def test_without_a_bound_one_table_of_the_index_is_searched(sides, tmp_path, monkeypatch):  # noqa: F811
    queries, chunks = sides
    index = ivf.build_index(chunks, str(tmp_path / "index"), tables=3)
    # each table holds every row: reading more than one of them compares rows again
    asked = []
    probes = ivf.probes
    monkeypatch.setattr(ivf, "probes", lambda *given: asked.append(probes(*given)) or asked[-1])
    search = lambda share: ivf.search_index(queries, index, 4, 0.1, share)
    sliced, streamed = both(monkeypatch, lambda: search(3.0))
    assert [a.agg(F.max("n_read")).first()[0] <= chunks.count() for a in asked] == [True, True]
    whole = queries.filter("embedding IS NOT NULL").alias("q").crossJoin(chunks.filter("embedding IS NOT NULL").alias("c")).select(
        "query_id", "chunk_id", F.round(retrieve.cosine(F.col("q.embedding"), F.col("c.embedding")), 9).alias("score")).filter("score >= 0.1").distinct()
    place = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)")
    assert streamed == sliced == rows(whole.withColumn("rn", place).filter("rn <= 4"))


def test_slices_of_a_bounded_search_hold_the_lists_of_one_table(sides, tmp_path, monkeypatch):  # noqa: F811
    queries, chunks = sides
    index = ivf.build_index(chunks, str(tmp_path / "index"), tables=3, lists=50)
    one = rows(ivf.search_index(queries, index, 4, 0.1, 0.3))
    sent, width = [], ivf.probes(queries, index, 0.1, 0.3).selectExpr("max(length(lists))").first()[0]
    send = product._searched
    monkeypatch.setattr(product, "_searched", lambda big, part, *more: sent.append(max(map(len, part["lists"]))) or send(big, part, *more))
    monkeypatch.setattr(ivf, "SLICE_BYTES", 16_000)
    assert rows(ivf.search_index(queries, index, 4, 0.1, 0.3)) == one
    assert len(sent) >= 6 and max(sent) <= width // 3 + 1


def test_what_a_query_has_found_bounds_its_other_lists(sides, tmp_path, monkeypatch):  # noqa: F811
    queries, chunks = sides
    once = chunks.dropDuplicates(["chunk_id"])
    index = ivf.build_index(once, str(tmp_path / "index"), tables=2, lists=40)
    few = rows(ivf.search_index(queries, index, 4, -1.0, 0.9))
    looked, exact = [], vector._exact
    monkeypatch.setattr(vector, "_exact", lambda a, r, b, c: looked.append(len(r)) or exact(a, r, b, c))
    small = ivf.probes(queries, index, -1.0, 0.9).toPandas()
    groups = index.rows().selectExpr("chunk_id", "tbl * 65536 + list AS grp", "embedding").toPandas()
    numbers = sorted(groups["grp"].unique())
    bits = np.unpackbits(np.frombuffer(b"".join(small["lists"]), np.uint8).reshape(len(small), -1), axis=1)
    known = index.lists()
    places, _ = ivf._bits(known)
    column = {t * 65536 + n: bits[:, b] for t, n, b in zip(known["tbl"], known["list"], places)}

    class Asked:
        def __init__(self, small):
            pass

        def get(self, group):
            return np.flatnonzero(column[group])

    def found():
        looked.clear()
        hits = pd.concat(vector.topk_search(4, -1.0, "own", Asked)(small)(groups)).drop_duplicates(["query_id", "chunk_id"])
        hits = hits.sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True]).groupby("query_id").head(4)
        return [tuple(r) for r in hits[["query_id", "chunk_id", "score"]].to_numpy().tolist()], sum(looked)

    plain, pairs = found()
    Asked.table_of = staticmethod(lambda group: group >> 16)
    bounded, fewer = found()
    assert bounded == plain and len(plain) == len(few) and len(numbers) > 40 and fewer < 0.9 * pairs


def test_nearest_lists_within_the_bound():
    rng = np.random.default_rng(2)
    cosine, may, n = rng.random((50, 400)).round(2), rng.random((50, 400)) < 0.7, rng.integers(1, 30, 400)
    for budget in (0, 60, 900, 1e6):
        for most in (3, 20, 400):
            chosen = ivf._nearest_within(cosine, may, n, budget, most)
            for row in range(50):
                order = [i for i in np.argsort(-cosine[row], kind="stable") if may[row, i]]
                ends = np.cumsum(n[order])
                least = cosine[row, order[max(1, int((ends <= budget).sum())) - 1]]
                assert chosen[row].sum() == max(1, (ends <= budget).sum()) and cosine[row, chosen[row]].min() == least
