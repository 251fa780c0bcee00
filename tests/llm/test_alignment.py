"""Alignment of two tokenizers against plain loops over whole-text library calls."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusflow.llm import alignment

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", " ", "a ", " a", "  a  b ", "a\n\nb", "\n", "tab\tand\r\nline", "▁x", "<s> plain </s> <unk> <|endoftext|>", "漢字、かな。" * 40, "Ａ①é́", "\x00a", "a   b",
       "-" * 300, "0123456789" * 30, "ẞ İstanbul ​ x", "word " * 500, "x" * 2000, "\xa0b   c", "👍🏽 ok"]


def plain_tokens(text, model, piece):
    whole = (" " + text).encode()
    byte_of = alignment.byte_of_letter
    a = [(i, bytes(map(byte_of, t))) for i, t in zip(*(lambda e: (e.ids, e.tokens))(model.encode(" " + text, add_special_tokens=False)))]
    b = []
    for i in piece.encode(text):
        p = piece.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()))
    return (a, b) if all(b"".join(x for _, x in side) == whole for side in (a, b)) and text else ([], [])


def plain_groups(a, b):
    def places(side):
        out, at = [], 0
        for i, raw in side:
            at += len(raw)
            out.append((at, i))
        return out

    a, b = places(a), places(b)
    cuts = sorted({e for e, _ in a} & {e for e, _ in b})
    groups, start = [], 0
    for cut in cuts:
        groups.append(([i for e, i in a if start < e <= cut], [i for e, i in b if start < e <= cut]))
        start = cut
    return groups


def plain(rows):
    model, piece = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    model.encode_special_tokens = True
    docs = []
    for doc, text in rows:
        a, b = plain_tokens(text or "", model, piece)
        groups = plain_groups(a, b)
        links = Counter((i, j) for x, y in groups for i in x for j in y)
        docs.append((doc, len(a), len(b), groups, links))
    count = Counter(pair for d in docs for pair in d[4])
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for doc, n_a, n_b, groups, links in docs:
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc, n_a, n_b, len(groups), sum(links.values()), sum(m for p, m in links.items() if count[p] == best[p[0]]),
                    sum(m * count[p] for p, m in links.items()), hashlib.sha256(line.encode()).hexdigest() if line else ""))
    return Counter(out)


def test_documents_and_odd_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60).collect()]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (7, None), (8, "same text"), (8, "same text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS row", "'x' AS radix", "2 AS part", "3 AS n_a")
    expected = plain(rows)
    assert Counter(map(tuple, alignment.align(docs, A, B).collect())) == expected
    # runs of a radix in many groups
    assert Counter(map(tuple, alignment.align(docs, A, B, merged_bytes=2_000).collect())) == expected
    assert alignment.align(docs.where("false"), A, B).count() == 0
    assert alignment.align(docs.where("text IS NULL"), A, B).select("n_a", "n_best", "groups_sha256").distinct().collect() == [(0, 0, "")]


def test_pieces_of_hard_texts():
    whole = sentencepiece.SentencePieceProcessor(model_file=B)
    mine = alignment.PieceEncoder(B, cached=2_000)
    rng = random.Random(5)
    texts = [t for t in ODD if "▁" not in t] + ["".join(rng.choice([" ", "  ", "a", "word", "\n", "é", "漢字", ".", "ing", "'s"]) for _ in range(rng.randrange(40))) for _ in range(400)]
    for _ in range(2):
        for at in range(0, len(texts), 50):
            some = texts[at:at + 50]
            assert [np.frombuffer(x, "<u4").tolist() for x in mine(some)] == [whole.encode(t) if t else whole.encode(" x")[:1] for t in some]


@pytest.mark.parametrize("limit", [1, 2])
def test_wide_groups(monkeypatch, limit):
    """Groups that are counted by distinct ids give the same runs."""
    texts = ["-" * 77 + "0123456789 plain words", "漢字かな" * 9, "other plain words ......"]
    narrow = aligned_runs(texts)
    monkeypatch.setattr(alignment, "WIDE", limit)
    *_, wide = alignment.aligned(texts, A, B)
    assert wide
    assert aligned_runs(texts) == narrow


def aligned_runs(texts):
    *_, keys, wide = alignment.aligned(texts, A, B)
    out = []
    for radix, n_pairs, n_records, heads, body in alignment.runs(keys, wide):
        pairs, counts = alignment._heads(heads, n_pairs)
        rows, links = alignment._columns(body, n_records, "<u4", "<u4")
        assert counts.sum() == n_records and (np.diff(pairs.astype(np.int64)) > 0).all()
        out.append((radix, pairs.tolist(), counts.tolist(), np.cumsum(rows, dtype=np.uint32).tolist(), links.tolist()))
    return out


def test_pieces_are_looked_up_in_small_blocks(monkeypatch):
    """However many texts are aligned at once, a look-up holds the words of a few; the pieces are those of whole texts."""
    whole, mine, held = sentencepiece.SentencePieceProcessor(model_file=B), alignment.PieceEncoder(B), []
    monkeypatch.setattr(mine.known, "of", lambda rows, *a, f=mine.known.of: held.append(sum(len(s) for r in rows for s in r)) or f(rows, *a))
    texts = [f"word{i % 7} and  more of it, été {i} " * 60 for i in range(300)]
    assert [np.frombuffer(raw, "<u4").tolist() for raw in mine(texts)] == [whole.encode(t) for t in texts]
    assert max(held) <= alignment.segments.LETTERS_AT_ONCE + max(map(len, texts)) and len(held) > 5
