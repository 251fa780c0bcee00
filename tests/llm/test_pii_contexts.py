"""Personal data by context: numbers in groups, words with digits before values, lists, patterns that found values induce."""

import pytest

from corpusflow.llm import pii


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in pii.find(df).collect():
        found = [s.split(":") for s in r.spans.split(",") if s]
        out[r.doc_id] = [(k, texts[r.doc_id][int(a):int(b)]) for k, a, b in found]
    return [out[i] for i in range(len(texts))]


CARDS = ["4111 1111 1111 1111", "5555 5555 5555 4444", "4012 8888 8888 1881", "4222 2222 2222 2", "6011 1111 1111 1117", "3530 1113 3330 0000"]
SEEDS = [f"call phone: +49 30 1234567{i:02} today" for i in range(30)] + [f"paid with card {c} once" for c in CARDS]


def test_numbers_in_groups(spark):
    values = ["017 555 7713", "0171 234 5678", "(555) 123-4567", "(555)123.4567", "1 (555) 123-4567"]
    texts = [f"ring phone: {v}, please" for v in values] + ["paid with card 4111 1111 1111 1112 twice", "some 017 555 7713 things"]
    found = spans(spark, SEEDS + texts)[len(SEEDS):]
    assert found == [[("phone", v)] for v in values] + [[("card", "4111 1111 1111 1112")], []]


def test_words_with_digits_before_values(spark):
    seeds = [f"phone1: +49 30 1234567{i:02} IPv4: 10.1.2.{i} contact #2 user{i}@host.org" for i in range(12)]
    found = spans(spark, [*seeds, "phone1: 5551234999", "IPv4: 10.1.2.x7", "contact #2 id-77821@intranet", "phone 5551234999"])[-4:]
    assert found == [[("phone", "5551234999")], [("ip", "10.1.2.x7")], [("email", "id-77821@intranet")], []]


@pytest.mark.parametrize("values", [["5551234999", "5551234888", "5551234777"], ["555-123-4567", "555-987-6543"], ["(555) 123-4567", "(555) 987-6543"]])
def test_lists(spark, values):
    for mark in (" ", ", "):
        assert spans(spark, [*SEEDS, f"call phone: {mark.join(values)} today"])[-1] == [("phone", v) for v in values]


def test_found_values_induce_patterns(spark):
    new = [f"01715550{i}" for i in range(4)]
    texts = [f"call phone: {v}" for v in new] + [f"ask durchwahl {v}" for v in new] + ["ask durchwahl 01719990"]
    found = spans(spark, SEEDS + texts)[len(SEEDS):]
    assert found == [[("phone", v)] for v in new] * 2 + [[("phone", "01719990")]]


def test_long_number_tables(spark):
    df = spark.createDataFrame([(0, "1 2 " * 4000), (1, "12-34 " * 3000), (2, "(1)" * 3000), (3, "1234567 " * 2000)], "doc_id long, text string")
    assert pii.find(df).where("spans = ''").count() == 4
