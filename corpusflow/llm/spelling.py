"""Spelling variants: full one-edit neighbourhoods of words over a reduced alphabet, verified on the words themselves."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.storage import discard, stored

# Letters of a run, and those that remain once A-Z are lower case.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))

MIN_CHARS = 7
MIN_COUNT = 2
#: A form is at least so many times as frequent as the word.
FORM_RATIO = 10
#: One run of so many, by hash, loses a letter.
SPOILED = 31
#: Symbols that letters are hashed to.
SYMBOLS = 8
#: Words of one reduced word that are compared through it; those of larger groups meet under the whole alphabet.
GROUP = 1_000
#: Bits that tell which reduced words may exist: a broadcast of at most 16 MiB, whatever the vocabulary.
FILTER_BITS = 1 << 27
#: Distinct words that a task adds up before it sends them, and keys that it makes at once.
HELD_WORDS = 300_000
KEYS_AT_ONCE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def run_counts(docs: DataFrame, spoiled: int = SPOILED, min_chars: int = MIN_CHARS) -> DataFrame:
    """(word, n): words of ``min_chars`` code points or more and their occurrences in whole texts, spoiled runs included.

    A run of letters, A-Z in lower case, loses the code point ``h % length`` if ``spoiled`` divides h, the crc32 of
    ``<doc_id>:<run>``; a null doc_id is the empty string. Tasks add up before anything moves.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
                runs = Counter(RUN.findall((text or "").encode().lower().decode()))  # of bytes, lower() changes A-Z only
                for run, n in runs.items():
                    if len(run) >= min_chars:
                        h = zlib.crc32(run.encode(), start)
                        if not h % spoiled:
                            at = h % len(run)
                            run = run[:at] + run[at + 1:]
                            if len(run) < min_chars:
                                continue
                        total[run] += n
            if len(total) >= HELD_WORDS:
                yield out()
                total.clear()
        yield out()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(keys: np.ndarray) -> np.ndarray:
    """Polynomials modulo 2^64 have poor low bits: spread all bits over all."""
    keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return keys ^ (keys >> np.uint64(32))


def word_keys(values: np.ndarray) -> np.ndarray:
    """A key for each row of symbols or letters (unsigned, none zero)."""
    return _mixed((values * _powers(values.shape[1])[:-1]).sum(axis=1, dtype=np.uint64))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n, _BASE, np.uint64)), dtype=np.uint64)


def edit_keys(values: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Keys of a row itself and of all that one deletion, replacement or insertion makes of it, in an order that depends on
    the sizes alone; repeats included."""
    n, length = values.shape
    power = _powers(length)
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(values * power[:-1], axis=1, dtype=np.uint64)], axis=1)
    total = before[:, -1:]
    deleted = before[:, :-1] + (total - before[:, 1:]) * _INVERSE
    replaced = total[:, :, None] + (alphabet - values[:, :, None]) * power[:-1, None]
    inserted = (before + (total - before) * np.uint64(_BASE))[:, :, None] + alphabet * power[:, None]
    return _mixed(np.concatenate([total, deleted, replaced.reshape(n, -1), inserted.reshape(n, -1)], axis=1))


def by_length(words: list[str], per_letter: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words of one length and their letters' code points; bounded by the keys that ``per_letter`` makes of them."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        where = np.flatnonzero(lengths == length)
        step = max(1, KEYS_AT_ONCE // (per_letter * (length + 1)))
        for at in range(0, len(where), step):
            some = where[at:at + step]
            codes = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le"), "<u4").reshape(len(some), length)
            yield some, codes.astype(np.uint64)


def symbols_of(codes: np.ndarray, symbols: int) -> np.ndarray:
    """The few symbols, 1 and up, that letters are hashed to."""
    return codes % np.uint64(symbols) + np.uint64(1)


def with_keys(words: DataFrame, symbols: int) -> DataFrame:
    """word, n and the key of the reduced word."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(batch.num_rows, np.uint64)
            for some, codes in by_length(batch.column("word").to_pylist(), 1):
                keys[some] = word_keys(symbols_of(codes, symbols))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))], ["word", "n", "key"])

    return words.select("word", "n").mapInArrow(reduce, "word string, n long, key long")


def key_filter(vocabulary: DataFrame) -> np.ndarray:
    """Bits that are set for the reduced words there are (by the low bits of their keys)."""
    place = (F.col("key").bitwiseAND(FILTER_BITS - 1) + 1).alias("p")
    buckets = vocabulary.select(place).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in buckets.toLocalIterator():  # at most FILTER_BITS / 8 bytes in all
        bits[(row.b - 1) * len(row.m):row.b * len(row.m)] = np.frombuffer(row.m, np.uint8)
    return bits


def neighbourhoods(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """(key, word, n): each word under all reduced words within one edit of its own that may exist, each once."""
    bits = vocabulary.sparkSession.sparkContext.broadcast(key_filter(vocabulary))
    alphabet = np.arange(1, symbols + 1, dtype=np.uint64)

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, codes in by_length(batch.column("word").to_pylist(), 2 * symbols + 1):
                keys = edit_keys(symbols_of(codes, symbols), alphabet)
                place = keys & np.uint64(FILTER_BITS - 1)
                row, column = np.nonzero(bits.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                row, keys = _once(row, keys[row, column])
                at = pa.array(some[row])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("word").take(at), batch.column("n").take(at)], ["key", "word", "n"])

    return vocabulary.select("word", "n").mapInArrow(generate, "key long, word string, n long")


def _once(row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key of a row once."""
    order = np.lexsort((keys, row))
    row, keys = row[order], keys[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
    return row[new], keys[new]


def whole_alphabet(rows: DataFrame, symbols: int, edits: bool) -> DataFrame:
    """(key, full, word, n): keys ``full`` over the whole alphabet, of the word of each row (key, word, n), or of all its edits
    whose reduced word has that key."""
    letters = np.array(sorted(map(ord, LETTERS)), np.uint64)

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("key").to_numpy().view(np.uint64)
            for some, codes in by_length(batch.column("word").to_pylist(), 2 * len(letters) + 1 if edits else 1):
                if edits:
                    reduced = edit_keys(symbols_of(codes, symbols), symbols_of(letters, symbols))
                    at, column = np.nonzero(reduced == asked[some, None])
                    at, full = _once(at, edit_keys(codes, letters)[at, column])
                else:
                    at, full = np.arange(len(some)), word_keys(codes)
                at = pa.array(some[at])
                yield pa.RecordBatch.from_arrays([batch.column("key").take(at), pa.array(full.view(np.int64)), batch.column("word").take(at),
                                                  batch.column("n").take(at)], ["key", "full", "word", "n"])

    return rows.select("key", "word", "n").mapInArrow(generate, "key long, full long, word string, n long")


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS, group: int = GROUP) -> DataFrame:
    """(word, n, near, n_near) for every two words one edit apart, both ways, of a stored ``vocabulary`` (word, n, key).

    Neighbourhoods meet the vocabulary by reduced word. Reduced words of more than ``group`` words would compare them all
    with each other: these few are generated again with the whole alphabet, where a key is one word.
    """
    near = F.col("word").alias("near"), F.col("n").alias("n_near")
    crowded = vocabulary.groupBy("key").count().where(F.col("count") > group).select("key")
    asking = stored(neighbourhoods(vocabulary, symbols), "neighbourhoods")
    few = asking.join(vocabulary.join(crowded, "key", "left_anti").select("key", *near), "key")
    many = whole_alphabet(asking.join(crowded, "key", "left_semi"), symbols, True).join(
        whole_alphabet(vocabulary.join(crowded, "key", "left_semi"), symbols, False).select("key", "full", *near), ["key", "full"])
    found = few.select("word", "n", "near", "n_near").union(many.select("word", "n", "near", "n_near"))
    return found.where(F.levenshtein("word", "near", 1) == 1)


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), a form being far more frequent than its word: where the forms end. Each round doubles the steps."""
    state = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stored(state.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = not new.where("moved").isEmpty()
        discard(state)
        state = new.select("word", "root")
        if not moved:
            return state


def variants(docs: DataFrame, min_count: int = MIN_COUNT, symbols: int = SYMBOLS, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of the documents.

    Words are runs of letters, some of them spoiled (``run_counts``), with at least 7 code points and ``min_count``
    occurrences. Words are near if one inserted, deleted or replaced code point makes one of the other. The form is
    the near word of greatest n (ties: smallest in code-point order) if that is at least ten times the word's n, else null; the
    root is where following the forms ends, the word itself without a form. Null and empty texts have no words;
    repeated rows count as often as they occur; a null doc_id is the empty string in the hash; an empty table gives no
    rows; other columns are left out.
    """
    counted = stored(run_counts(docs).where(F.col("n") >= min_count), "words")
    vocabulary = stored(with_keys(counted, symbols), "vocabulary")
    best = F.min(F.struct((-F.col("n_near")).alias("less"), "near"))
    around = stored(near_words(vocabulary, symbols, group).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
                    .select("word", "n_near", "best.near", (-F.col("best.less")).alias("near_n")), "around")
    full = vocabulary.select("word", "n").join(around, "word", "left").withColumn("has_form", F.col("near_n") >= FORM_RATIO * F.col("n"))
    full = stored(full.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has_form"), F.col("near")).alias("form"),
                              F.when(F.col("has_form"), F.col("near_n")).alias("form_n")), "forms")
    roots = followed(full.where("form IS NOT NULL"))
    return full.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
