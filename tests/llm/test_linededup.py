"""Line deduplication against a plain loop: hot keys over many partitions, odd rows, the bitmap format."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusflow.llm import linededup

SCHEMA = "doc_id long, text string"
BLANK = " \t\n\x0b\x0c\r"


def plain(rows, min_chars=20, min_docs=3):
    lower = {i: i + 32 for i in range(65, 91)}
    ids = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            ids[line.strip(BLANK).translate(lower)].add((doc is not None, doc or 0))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            key = line.strip(BLANK).translate(lower)
            if len(key) < min_chars or len(ids[key]) < min_docs or max(ids[key]) == (doc is not None, doc or 0):
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def check(spark, rows, **how):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS high", "1 AS doc", "2L AS text_key", "3 AS pos", "true AS keep_bits")
    assert Counter(map(tuple, linededup.deduplicate(docs, **how).collect())) == plain(rows, **how)


def test_odd_rows(spark):
    line = "A shared line that is long enough"
    rows = [(1, line), (2, f"  {line.upper()}\t\nown line of the second document"), (3, f"{line}\n\n{line}\r"), (None, line), (None, f"x\n{line}"),
            (4, None), (5, ""), (6, "\n\n"), (7, "Übermäßig lange Zeile, mehrfach"), (8, "übermäßig lange Zeile, mehrfach"), (9, "Übermäßig lange Zeile, mehrfach"),
            (9, "Übermäßig lange Zeile, mehrfach"), (10, "twenty code points.."), (11, "twenty code points.."), (12, "twenty code points.."),
            (13, "nineteen characters"), (14, "nineteen characters"), (15, "nineteen characters"), (-5, "two documents hold this line"),
            (-6, "two documents hold this line"), (-6, "two documents hold this line")]
    check(spark, rows)
    check(spark, rows, min_docs=2)
    check(spark, rows, min_docs=5, min_chars=1)
    assert linededup.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("min_docs", [2, 3, 5])
def test_hot_keys_over_partitions_and_batches(spark, min_docs):
    """A few keys fill several range partitions, and batches of a few rows cut the keys everywhere."""
    rng = random.Random(min_docs)
    lines = [f"line number {i} of those that repeat" for i in range(40)]
    rows = []
    for doc in range(600):
        text = [lines[min(int(rng.expovariate(0.4)), 39)] for _ in range(rng.randrange(6))] + [f"only here {doc} " * 3]
        rows.append((doc if doc % 7 else doc // 2, "\n".join(text)))
    rows += rows[:50]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(size, 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows, min_docs=min_docs)
    finally:
        spark.conf.set(size, before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_one_long_text_and_bitmap_column(spark):
    shared = [f"repeated passage line {i:05d}" for i in range(5000)]
    rows = [(i, "\n".join(shared)) for i in range(3)] + [(9, "short")]
    check(spark, rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    bitmaps = linededup.keep_bitmaps(docs)
    sizes = [(r.doc, r.n_dropped, len(r.keep_bits)) for r in bitmaps.collect()]
    assert sorted(x[:2] for x in sizes) == [(0, 5000), (1, 5000)] and max(x[2] for x in sizes) < 40
    kept = linededup.with_bitmaps(docs, bitmaps).select("doc_id", linededup.without_repeats("text", "keep_bits").alias("t")).collect()
    assert {r.doc_id: len(r.t) for r in kept} == {0: 0, 1: 0, 2: len(rows[2][1]), 9: 5}


def test_bits():
    rng = random.Random(1)
    for n in (1, 7, 8, 9, 300, 5000):
        gone = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
        keep = linededup.unpack_bits(linededup.pack_bits(gone), n + 3)
        assert np.flatnonzero(~keep).tolist() == gone
    assert linededup.unpack_bits(None, 4).all()
