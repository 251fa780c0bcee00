"""Spelling variants against all pairs of words, crowded reduced words, odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusflow.llm import spelling

SF = "/root/testdata/sf0.001"


def edits(word):
    letters = spelling.LETTERS
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in letters}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return out - {word}


def is_near(a, b):
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:])


def plain(rows):
    lower, n = {i: i + 32 for i in range(65, 91)}, Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    out = {}
    for w in n:
        near = [x for x in edits(w) if x in n] if len(w) < 40 else [x for x in n if is_near(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = [form, w, n[w], len(near), form and n[form]]
    for w, row in out.items():
        while out[row[1]][0] is not None:
            row[1] = out[row[1]][0]
    return {(w, *row) for w, row in out.items()}


def check(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS key")
    found = [tuple(r) for r in spelling.variants(docs, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert set(found) == plain(rows) and len(found) == len(set(found))
    return found


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = check(spark, rows)
    assert sum(r[1] is not None for r in found) >= 5


@pytest.mark.parametrize("symbols,group", [(2, 1000), (2, 3), (8, 0), (100, 2)])
def test_crowded_reduced_words(spark, symbols, group):
    """Words that share few reduced words, some of these with more words than are compared through them."""
    rng = random.Random(symbols)
    words = set()
    while len(words) < 300:
        words.add("".join(rng.choice("aiqyéê÷") for _ in range(rng.choice([7, 8, 8, 9]))))
    words = sorted(words)
    text = " ".join(w for i, w in enumerate(words) for _ in range(rng.choice([2, 3, 40, 500])))
    found = check(spark, [(i, text) for i in range(3)], symbols=symbols, group=group)
    assert sum(r[4] for r in found) >= 30


def test_odd_rows(spark):
    long = "abcdefgh" * 2500
    rows = [(1, "Wortform wortform WORTFORM wortförm Wortform, " * 9 + "wortfrom wortfrom"), (None, "wortform wortforms wortforms"), (2, None), (3, ""),
            (1, "Wortform wortform"), (1, "Wortform wortform"), (4, f"{long} {long} {long}x {long[1:]} {long[1:]} {long}x"), (5, "kürzer kürzer Äpfelchen äpfelchen Äpfelchen"),
            (-7, "zzzzzzz zzzzzzz zzzzzzzz zzzzzzzz " * 30), (8, "a1b2 1234567 \n\t")]
    found = check(spark, rows)
    assert any(len(r[0]) > 19_000 and r[4] == 2 for r in found)
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chains_end_in_one_root(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(37)]
    found = dict(map(tuple, spelling.followed(spark.createDataFrame(forms, "word string, form string")).collect()))
    assert found == {f"w{i}": "w37" for i in range(37)}


def test_keys_of_edits():
    letters = np.array(sorted(map(ord, spelling.LETTERS)), np.uint64)
    for word in ("aaaaaaa", "wortform", "été"):
        ((_, codes),) = spelling.by_length([word], 1)
        keys = {int(k) for k in spelling.edit_keys(codes, letters)[0]}
        expected = {int(spelling.word_keys(c)[0]) for w in edits(word) | {word} for _, c in spelling.by_length([w], 1)}
        assert keys == expected and len(expected) == len(edits(word)) + 1
