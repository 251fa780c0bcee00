"""The catalog query sums a listing up once per region, not once per question."""

from corpusflow.operators import recommend
from corpusflow.plans import q_recommend


def test_no_row_per_question_and_tenant(spark, monkeypatch):
    tenants = spark.createDataFrame([(f"t{i}", f"Hotel {i}", "d", "Tirol" if i % 2 else "Wien", "Ort", "Land", i != 5) for i in range(40)],
                                    "tenant_id string, name string, domain string, region string, location string, country string, is_active boolean")
    rows = [(i, ("Tirol", "Wien", None, "nowhere")[i % 4]) for i in range(100)] + [(1, "Wien"), (2, None), (None, "Tirol")]
    questions = spark.createDataFrame(rows, "query_id long, region string")
    made, catalog = [], recommend.catalog

    def counted(*args):
        out = catalog(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(recommend, "catalog", counted)
    found = {r["query_id"]: tuple(r)[1:] for r in q_recommend._catalog_figures(questions, tenants).collect()}
    assert made == [19 + 20 + 39]
    odd, even = sum(i for i in range(1, 40, 2) if i != 5), sum(range(0, 40, 2))
    assert found[0] == (19, 19, "t1", odd) and found[None] == found[0] and found[5] == (20, 20, "t0", even)
    assert found[1] == (40, 20, "t0", 2 * even) and found[2] == (78, 39, "t0", 2 * (odd + even))
    assert 3 not in found and len(found) == 76
