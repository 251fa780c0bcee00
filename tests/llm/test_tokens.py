"""Segment encoders, codes, byte BPE and packing against the libraries called on whole texts."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusflow.llm import bytebpe, codes, packing, segments
from corpusflow.session import shared_folder

SF = "/root/testdata/sf0.001"
BYTES, WORDS, RANKS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
PIECES = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", "a", "word", "'s", "'re", "don't", "12", "3.5", "|", " | ",
          "é", "é", "́", "Σ", "ß", "İ", "漢字", "👍🏽", "<|endoftext|>", "<|startoftext|>", "%%%", "\x00", "_", "A"]
HARD = ["", " ", "a", " a", "a ", "\n\n a  b\n c \n", "x" * 3000, "1" * 500, "<|endoftext|> tail", "a | b", "| a", "a\nb | c\nd", "  lead", "tail  ",
        " ́ a ́b", "word " * 5000, "a\nb", "a \nb", "a\n b", "a\n\nb", "\na", "a\n", "a\r\nb", "'s\n's 's", "one two.\nThree four\n\n five\nsix",
        "Ċ aĊb İstanbul ŉ ß ẞ Ǆ ƻ 'ord word' it's. (word) a|b |c| d| word.', end%%% x_ _ '' é. É,, ñ!?", "a ", " a", "  ", "\u0138 \u02b0 ª º µ"]


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def tiktoken_ids():
    encoding = segments.rank_encoding(RANKS, P.PATTERN)
    return encoding.encode_ordinary


CASES = {"bytes": (segments.byte_encoder(BYTES), library(BYTES)), "words": (segments.word_encoder(WORDS), library(WORDS)),
         "ranks": (segments.rank_encoder(RANKS, P.PATTERN), tiktoken_ids())}


def ids_of(raw):
    return np.frombuffer(raw, dtype="<u4").tolist()


@pytest.mark.parametrize("kind", CASES)
def test_hard_texts(kind):
    mine, whole = CASES[kind]
    for text, raw in zip(HARD, mine(HARD)):
        assert ids_of(raw) == whole(text), repr(text)
    assert mine([None, ""]) == [b"", b""]


@pytest.mark.parametrize("kind", CASES)
@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.one_of(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), st.text(max_size=20)), max_size=4))
def test_any_texts(kind, texts):
    mine, whole = CASES[kind]
    assert [ids_of(x) for x in mine(texts)] == [whole(t) for t in texts]


def unspaced(n, seed):
    import random

    rng = random.Random(seed)
    return ["".join(rng.choice(["，", "。", "漢", "字", "い", "ろ", "é", "x", "word", "3", "…", "(", ")", "'s", ".", "́", "한"]) for _ in range(rng.randrange(400))) for _ in range(n)]


@pytest.mark.parametrize("kind", CASES)
def test_texts_without_spaces(kind):
    mine, whole = CASES[kind]
    texts = unspaced(150, 3)
    for _ in range(2):
        assert [ids_of(x) for x in mine(texts)] == [whole(t) for t in texts]


def test_memory_is_bounded_by_bytes():
    """Texts without spaces, each another one, leave no more in the cache than it may hold."""
    encoder = segments.SegmentEncoder(CASES["bytes"][0].rest.encode, cached=100_000)
    for at in range(40):
        encoder([" ".join(unspaced(20, at))])
        for side in (encoder.heads, encoder.rest):
            assert all(len(s) <= segments.REMEMBERED_CHARS for some in (side.now, side.past) for s in some)
            held = sum(2 * len(s) + len(v) + segments.ENTRY_BYTES for s, v in side.now.items())
            assert held <= side.held <= 100_000 + 600_000
    assert encoder.heads.past


def test_segments_are_looked_up_in_small_blocks(monkeypatch):
    """However many texts are given at once, a look-up holds the segments of a few; the ids are those of whole texts."""
    encoder, held = segments.SegmentEncoder(CASES["bytes"][0].rest.encode), []
    monkeypatch.setattr(encoder.rest, "of", lambda rows, *a, f=encoder.rest.of: held.append(sum(len(s) for r in rows for s in r)) or f(rows, *a))
    texts = [*HARD, *(f"word{i} and more of it, " * 40 for i in range(400))]
    assert [ids_of(raw) for raw in encoder(texts)] == [CASES["bytes"][1](t) for t in texts]
    assert max(held) <= segments.LETTERS_AT_ONCE + max(map(len, texts)) and len(held) > 5


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_words_go_to_the_model_alone(kind, monkeypatch):
    """Letters with or without punctuation cost no pass of the whole tokenizer; it was called on each group of them."""
    import tokenizers

    calls = []

    class Whole:
        def __init__(self, inner):
            vars(self)["inner"] = inner

        @classmethod
        def from_file(cls, path, load=tokenizers.Tokenizer.from_file):
            return cls(load(path))

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def __setattr__(self, name, value):
            setattr(self.inner, name, value)

        def encode_batch_fast(self, texts, **more):
            calls.extend(texts)
            return self.inner.encode_batch_fast(texts, **more)

    monkeypatch.setattr(tokenizers, "Tokenizer", Whole)
    encoder = (segments.byte_encoder if kind == "bytes" else segments.word_encoder)(BYTES if kind == "bytes" else WORDS)
    text = " ".join(f"{a}{b}{end}" for a in ("Straße", "word", "ÉTÉ") for b in "abcdefghij" for end in ("", ",", ".\nUnd", "!?"))
    assert ids_of(encoder([text])[0]) == CASES[kind][1](text)
    assert set(calls) <= {"\n", ",", ".", "!?"}


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_remembered_letters_are_not_tokenized_again(kind, monkeypatch):
    """A word with punctuation behind takes the ids of its letters from the word without; only that word went to the model."""
    import tokenizers

    calls = []

    class Model:
        def __init__(self, inner):
            self.inner = inner

        def tokenize(self, letters):
            calls.append(letters)
            return self.inner.tokenize(letters)

    class Whole:
        def __init__(self, inner):
            vars(self)["inner"] = inner

        @classmethod
        def from_file(cls, path, load=tokenizers.Tokenizer.from_file):
            return cls(load(path))

        def __getattr__(self, name):
            return Model(self.inner.model) if name == "model" else getattr(self.inner, name)

        def __setattr__(self, name, value):
            setattr(self.inner, name, value)

    monkeypatch.setattr(tokenizers, "Tokenizer", Whole)
    encoder = (segments.byte_encoder if kind == "bytes" else segments.word_encoder)(BYTES if kind == "bytes" else WORDS)
    words = [f"{a}{b}" for a in ("Straße", "word", "ÉTÉ", "İx", "Σας", "漢") for b in "abcdefghij"]
    plain = ". " + " ".join(words)
    texts = [plain, *(". " + " ".join(w + end for w in words) for end in (",", ".", "'", "!?", "|", "'s"))]
    assert [ids_of(raw) for raw in encoder(texts)] == [CASES[kind][1](t) for t in texts]
    assert len(calls) == len(set(calls)) == (40 if kind == "bytes" else 30)  # in lower case, İ is a letter and a mark


def test_a_worker_remembers_many_segments():
    """300,000 words, fewer than a corpus has, take one generation, so each is encoded once."""
    asked = []
    encoder = segments.SegmentEncoder(lambda before, segment, *more: asked.append(segment) or b"1234")
    texts = ["x " + " ".join(f"w{i:07d}" for i in range(at, at + 1000)) for at in range(0, 300_000, 1000)]
    first = encoder(texts)
    n = len(asked)
    assert encoder(texts) == first and len(asked) == n


def test_full_cache_starts_anew():
    small = segments.SegmentEncoder(CASES["bytes"][0].rest.encode, cached=3)
    for text in ["a b c d e", "c d e f", "a b", "", "c d", "a b c d e f g h", "a f"]:
        assert ids_of(small([text])[0]) == CASES["bytes"][1](text)


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(None, "no id"), (7, None), (7, ""), (8, "same"), (8, "same"), (9, "x " * 9000)], "doc_id long, text string")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd) \
        .selectExpr("doc_id", "text", "1 AS start", "'x' AS part", "2 AS n")


def test_byte_bpe(docs):
    whole = CASES["ranks"][1]
    want = []
    for r in docs.collect():
        ids = whole(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [tuple(r) for r in bytebpe.round_trip(docs, RANKS, P.PATTERN).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_byte_bpe_columns(docs):
    ids = bytebpe.encode("text", RANKS, P.PATTERN)
    rows = docs.select("text", bytebpe.decode(ids, RANKS).alias("back")).collect()
    assert all(bytes(r.back) == (r.text or "").encode() for r in rows)


def test_codes_file(spark, docs):
    folder = shared_folder(spark, "codes")
    codes.write_codes(docs, folder, BYTES, block_ids=1000)
    got = codes.documents_of(codes.read_codes(spark, folder)).collect()
    whole, stream, want = CASES["bytes"][1], {}, defaultdict(list)
    for r in docs.collect():
        ids = [*whole(r.text or ""), 2]
        want[r.doc_id].append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        stream[(r.doc_id, len(ids))] = ids
    assert len(got) == docs.count()
    for k in want:
        assert sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == k) == sorted(want[k])
    at, last = 0, None
    everything = []
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        key = (r.doc_id is not None, r.doc_id or 0)
        assert last is None or key >= last
        at, last = at + r.n_tokens, key
        everything += stream[(r.doc_id, r.n_tokens)]
    places = [0, 1, 255, 256, 1000, at - 1, at, -1, 5000, 5000]
    found = codes.tokens_at(spark, folder, spark.createDataFrame([(p,) for p in places], "place long")).collect()
    assert sorted((r.place, r.token_id) for r in found) == sorted((p, everything[p]) for p in places if 0 <= p < at)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 2**16), st.integers(0, 2**32 - 1)), max_size=1500))
def test_levels(ids):
    levels = codes.to_levels(np.array(ids, dtype="<u4"))
    assert codes.from_levels(levels).tolist() == ids
    for i in range(0, len(ids), 97):
        assert codes.access(levels, i) == ids[i]


def test_codes_of_nothing(spark, docs):
    folder = shared_folder(spark, "codes")
    codes.write_codes(docs.where("false"), folder, BYTES)
    assert codes.documents_of(codes.read_codes(spark, folder)).count() == 0


def first_fit(sizes, capacity):
    bins, out = [], []
    for s in sizes:
        k = next((i for i, used in enumerate(bins) if used + s <= capacity), len(bins))
        if k == len(bins):
            bins.append(0)
        out.append((k, bins[k]))
        bins[k] += s
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_tournament_tree(sizes):
    tree = packing.TournamentTree(40)
    assert [tree.place(s) for s in sizes] == first_fit(sizes, 40)


def test_packing_looks_up_small_blocks(monkeypatch):
    """A worker's batch of short texts is cut by letters, not by rows; the pieces hold the ids of whole texts."""
    encoder, held = segments.SegmentEncoder(CASES["words"][0].rest.encode), []
    monkeypatch.setattr(encoder.rest, "of", lambda rows, *a, f=encoder.rest.of: held.append(sum(len(s) for r in rows for s in r)) or f(rows, *a))
    texts = [f"Wort{i % 9} und word {i}, ÉTÉ. " * 100 for i in range(256)]
    assert [ids_of(raw) for raw in encoder(texts)] == [CASES["words"][1](t) for t in texts]
    assert max(held) <= segments.LETTERS_AT_ONCE + max(map(len, texts))


def test_packing(docs):
    rows = packing.pack_documents(docs, WORDS, capacity=256, group_documents=50).collect()
    whole = CASES["words"][1]
    want = sorted((str(r.doc_id), len(whole(r.text or "")) + 1) for r in docs.collect())
    assert sorted((str(r.doc_id), r.doc_tokens) for r in rows if r.start == 0) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 7").collect()}
    for r in rows:
        if r.doc_id in texts:
            ids = [*whole(texts[r.doc_id]), 2][r.start:r.start + r.length]
            assert (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) == (r.length, r.ids_crc32)
    total = sum(r.length for r in rows)
    assert total / (256 * len(sequences)) > 0.95
    assert packing.pack_documents(docs.where("false"), WORDS).count() == 0
