"""Compression bands: encoded data and random words are rejected, prose of every length stays."""

import base64
import random
import string

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import quality

SF = "/root/testdata/sf0.01"


def spaced(rnd, letters, size, most, least=None):
    words, n = [], 0
    while n < size:
        words.append("".join(rnd.choices(letters, k=rnd.randint(least or most, most))))
        n += len(words[-1]) + 1
    return " ".join(words)[:size]


def encoded(rnd, size):
    raw = base64.b64encode(rnd.randbytes(size)).decode()
    return " ".join(raw[i:i + 8] for i in range(0, len(raw), 8))[:size]


MADE = {
    "base64": encoded,
    "letters": lambda rnd, size: spaced(rnd, string.ascii_lowercase, size, 9, 3),
    "hex8": lambda rnd, size: spaced(rnd, "0123456789abcdef", size, 8),
    "digits": lambda rnd, size: spaced(rnd, string.digits, size, 6),
}
#: Which of them stay at a length, since prose of that length compresses no better (README).
PASSING = {500: {"letters", "hex8", "digits"}, 1_500: {"letters", "hex8", "digits"}, 3_000: {"hex8", "digits"}, 10_000: {"digits"}}


@pytest.mark.parametrize("size", PASSING)
def test_encoded_and_random_texts(size):
    for name, make in MADE.items():
        if name not in PASSING[size]:
            for seed in range(10):
                row = quality._measure(make(random.Random(seed), size))
                assert not row[9] and not row[10], (name, size, row)  # rejected by the bands, not by the fixed rules


def test_prose_is_not_below_the_bands(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select(F.octet_length("text").alias("n"), quality.statistics("text").alias("s")).where("not s.base_failed").select("n", "s.*").collect()
    assert rows and all(r.ratio >= quality._band(r.n)[0] for r in rows)
    assert not any(r.n_random_chunks for r in rows)
