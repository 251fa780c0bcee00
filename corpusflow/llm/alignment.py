"""Cross-tokenizer alignment: links between the tokens of two vocabularies, counted externally.

Tasks tokenize whole texts and cut the links into records (A id, B id, document), radix-partitioned by A id and sorted into
zstd runs. A group of runs, a radix of some tasks, is merged with a heap to count the documents of each pair; the counts in
order of the A id give each id's maximum, and what every document gains from its pairs streams back from the same runs.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import segments
from corpusflow.llm.segments import CACHED_BYTES, Remembered, bounded, byte_encoder_of, byte_of_letter, four_bytes
from corpusflow.llm.storage import stored

#: Letters that are tokenized at once; one longer text goes alone.
LETTERS_AT_ONCE = 1 << 20
#: Link records that a task sorts at once.
RECORDS = 1 << 22
#: Bits of the A id that choose a radix partition, bits of an id, and bits of a document within a run.
RADIX_BITS, ID_BITS, ROW_BITS = 4, 20, 24
#: Compressed bytes of the runs that are merged together, about.
MERGED_BYTES = 24 << 20
#: Groups with more links are counted by their distinct ids instead of being written out.
WIDE = 4_096


def byte_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary."""
    from tokenizers import Tokenizer

    spelled = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    table = [b""] * (max(spelled.values()) + 1)
    for token, at in spelled.items():
        table[at] = bytes(map(byte_of_letter, token))
    return table


class PieceEncoder:
    """Ids of texts by a sentencepiece model that puts a space before each text.

    No piece has a space behind another letter, so what stands before a run of spaces never changes what follows, and
    ids are put together from remembered words. A model with such pieces encodes whole texts.
    """

    _CUT = re.compile("(?<=[^ ])(?= )")

    def __init__(self, path: str, cached: int = CACHED_BYTES):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        # fixed forms: U+2581 is a space, <0xHH> a byte
        self.bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.whole = any("▁" in p.lstrip("▁") for p in pieces)
        space = np.array([model.piece_to_id("▁")], "<u4").tobytes()

        packed_ids = four_bytes(len(pieces))

        def encode(before: str, segment: str, known: Callable[[str], bytes | None]) -> bytes:
            return b"".join([packed_ids[i] for i in model.encode(segment)]) if segment or self.whole else space

        self.known = Remembered(encode, "", cached, cut=None)  # parts of a long word would each get a space

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return self.known.of([[t] for t in texts], 0, None)
        return [ids for some in bounded(texts, segments.LETTERS_AT_ONCE) for ids in self._ids(some)]

    def _ids(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") if "  " not in t and t[:1] != " " else [s[1:] for s in self._CUT.split(" " + t)] for t in texts]
        return self.known.of(split, 0, None)


@cache
def _vocabularies(a_path: str, b_path: str):
    """Encoders, bytes and byte lengths of both sides, and the decimals that write groups. One set per worker."""
    a, b = byte_encoder_of(a_path), PieceEncoder(b_path)
    a_bytes, b_bytes = byte_tokens(a_path), b.bytes
    if max(len(a_bytes), len(b_bytes)) > 1 << ID_BITS:
        raise ValueError(f"ids of more than {ID_BITS} bits")
    written = [b"%d%c" % (i, mark) for table, marks in ((a_bytes, b",|"), (b_bytes, b",;")) for mark in marks for i in range(len(table))]
    return a, b, a_bytes, b_bytes, np.array([len(x) for x in a_bytes]), np.array([len(x) for x in b_bytes]), written


def _ends(ids: list[bytes], table: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    every = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
    return every, np.cumsum(lengths[every])


def aligned(texts: list[str], a_path: str, b_path: str):
    """(n_a, n_b, n_groups, n_links, digests, keys, wide) of texts.

    The first four and the digests are one per text. ``keys`` holds (text, A id, B id) of each link, packed by ``packed``; ``wide`` holds
    (key, number of links) arrays for groups of very many links. A text whose tokens do not spell it has no tokens.
    """
    a, b, a_bytes, b_bytes, a_lengths, b_lengths, written = _vocabularies(a_path, b_path)
    n = len(texts)
    a_ids = a([" " + t for t in texts])
    b_ids = b(texts)
    sound = []
    for i, text in enumerate(texts):
        raw = (" " + text).encode()
        sound.append(text != "" and all(b"".join(map(table.__getitem__, np.frombuffer(ids[i], "<u4").tolist())) == raw for ids, table in ((a_ids, a_bytes), (b_ids, b_bytes))))
    a_ids, b_ids = ([raw if fine else b"" for raw, fine in zip(side, sound)] for side in (a_ids, b_ids))
    n_a, n_b = (np.array([len(x) // 4 for x in side], np.int64) for side in (a_ids, b_ids))
    x, x_end = _ends(a_ids, a_bytes, a_lengths)
    y, y_end = _ends(b_ids, b_bytes, b_lengths)
    if not len(x):
        return n_a, n_b, np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n, np.zeros(0, np.uint64), []
    # texts stand one behind the other, so a text's end is an end on both sides
    x_last = y_end[np.searchsorted(y_end, x_end)] == x_end
    y_last = x_end[np.searchsorted(x_end, y_end)] == y_end
    x_group, y_group = np.cumsum(x_last) - x_last, np.cumsum(y_last) - y_last
    x_size, y_size = np.bincount(x_group), np.bincount(y_group)
    x_start, y_start = np.cumsum(x_size) - x_size, np.cumsum(y_size) - y_size
    doc = np.repeat(np.arange(n), n_a)
    group_doc = doc[x_start]
    links = x_size * y_size
    n_links = np.zeros(n, np.int64)
    np.add.at(n_links, group_doc, links)
    # every A token of a narrow group with every B token of it
    narrow = np.where(links <= WIDE, y_size, 0)[x_group]
    i = np.repeat(np.arange(len(x)), narrow)
    j = np.arange(len(i)) - np.repeat(np.cumsum(narrow) - narrow, narrow) + y_start[x_group[i]]
    wide = []
    for g in np.flatnonzero(links > WIDE):
        (ua, ca), (ub, cb) = (np.unique(ids[at:at + size], return_counts=True) for ids, at, size in ((x, x_start[g], x_size[g]), (y, y_start[g], y_size[g])))
        wide.append((packed(group_doc[g], ua[:, None], ub[None, :]).ravel(), np.outer(ca, cb).ravel()))
    # the tokens as written: those of A in a group, then those of B
    tokens = np.zeros(len(x) + len(y), np.int64)
    tokens[np.arange(len(x)) + y_start[x_group]] = x + len(a_bytes) * x_last
    tokens[np.arange(len(y)) + (x_start + x_size)[y_group]] = y + 2 * len(a_bytes) + len(b_bytes) * y_last
    stops = np.cumsum(n_a + n_b)
    lines = [b"".join(map(written.__getitem__, tokens[e - k:e].tolist()))[:-1] for e, k in zip(stops.tolist(), (n_a + n_b).tolist())]
    digests = [hashlib.sha256(line).hexdigest() if line else "" for line in lines]
    return n_a, n_b, np.bincount(group_doc, minlength=n), n_links, digests, packed(doc[i], x[i], y[j]), wide


def packed(row, a, b) -> np.ndarray:
    """Radix, rest of the A id, B id and row in 64 bits: sorted, they are side-major within a radix."""
    a, b, row = (np.asarray(v).astype(np.uint64) for v in (a, b, row))
    low = np.uint64((1 << RADIX_BITS) - 1)
    a = (a & low) << np.uint64(ID_BITS - RADIX_BITS) | a >> np.uint64(RADIX_BITS)
    return (a << np.uint64(ID_BITS) | b) << np.uint64(ROW_BITS) | row


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns of one length, bytes of equal weight side by side, in zstd."""
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _columns(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def runs(keys: np.ndarray, wide: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(radix, pairs, records, heads, body) of the link keys of some documents: heads are the pairs and their numbers of records,
    the body is the row and the number of links of each record."""
    keys.sort()
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    each, n_links = keys[starts], np.diff(np.append(starts, len(keys)))
    if wide:
        each, n_links = (np.concatenate([v, *w]) for v, w in zip((each, n_links), zip(*wide)))
        order = np.argsort(each, kind="stable")
        each, n_links = each[order], n_links[order]
        starts = np.flatnonzero(np.append(True, each[1:] != each[:-1]))
        each, n_links = each[starts], np.add.reduceat(n_links, starts)
    cuts = np.searchsorted(each, np.arange(1, 1 << RADIX_BITS, dtype=np.uint64) << np.uint64(64 - RADIX_BITS))
    for radix, (records, n) in enumerate(zip(np.split(each, cuts), np.split(n_links, cuts))):
        if len(records):
            pairs = records >> np.uint64(ROW_BITS)
            starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            heads = _squeezed(np.diff(pairs[starts], prepend=np.uint64(0)), np.diff(np.append(starts, len(pairs))).astype("<u4"))
            rows = (records & np.uint64((1 << ROW_BITS) - 1)).astype("<u4")
            yield radix, len(starts), len(records), heads, _squeezed(np.diff(rows, prepend=np.uint32(0)), n.astype("<u4"))


def _heads(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    pairs, counts = _columns(blob, n, "<u8", "<u4")
    return np.cumsum(pairs, dtype=np.uint64), counts


_TOKENIZED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "radix int, part long, n_pairs long, n_records long, heads binary, body binary")


def tokenized(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of documents (radix null), and of runs whose records name documents by their distance from ``row``."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, _TOKENIZED.split(", "))])

    def batch_of(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40  # documents of a task are fewer than 2^40
        seen = base = 0
        keys: list[np.ndarray] = []
        wide: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            found = list(runs(np.concatenate(keys), wide))
            radix, n_pairs, n_records, heads, body = zip(*found) if found else [()] * 5
            keys.clear()
            wide.clear()
            return batch_of(row=[part + base] * len(radix), radix=radix, part=[part >> 40] * len(radix), n_pairs=n_pairs, n_records=n_records, heads=heads, body=body)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            size = np.cumsum([len(t) for t in texts])
            bins = (size // LETTERS_AT_ONCE).tolist()
            at = 0
            for _, some in groupby(bins):
                n = sum(1 for _ in some)
                n_a, n_b, n_groups, n_links, digests, found, many = aligned(texts[at:at + n], a_path, b_path)
                shift = np.uint64(seen - base)
                keys.append(found + shift)
                wide += [(k + shift, m) for k, m in many]
                yield batch_of(row=part + seen + np.arange(n), doc_id=ids[at:at + n], n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups_sha256=digests)
                at, seen = at + n, seen + n
                if sum(map(len, keys)) >= RECORDS or seen - base >= 1 << ROW_BITS - 1:
                    yield flush()
                    base = seen
        if keys:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokenize, _TOKENIZED)


def counted(parts: DataFrame) -> DataFrame:
    """(radix, pair, n): in how many documents of the runs a pair is linked, by a heap merge of the heads of each group of runs."""

    def merge(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        sides = [zip(*(v.tolist() for v in _heads(blob, n))) for blob, n in zip(found["heads"], found["n_pairs"])]
        merged = [(pair, sum(map(itemgetter(1), same))) for pair, same in groupby(heapq.merge(*sides), key=itemgetter(0))]
        return pd.DataFrame(merged, columns=["pair", "n"], dtype="int64").assign(radix=key[0])

    partial = parts.select("radix", "salt", "n_pairs", "heads").groupBy("radix", "salt").applyInPandas(merge, "radix int, pair long, n long")
    return partial.groupBy("radix", "pair").agg(F.sum("n").alias("n"))


def gained(parts: DataFrame, totals: DataFrame, salts: int) -> DataFrame:
    """(row, n_best, count_sum): what documents gain from the pairs of each group of runs."""

    def back(key: tuple, found: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        counts = counts.sort_values("pair")  # side-major: the pairs of an A id stand together
        pairs, n = counts["pair"].to_numpy().astype(np.uint64), counts["n"].to_numpy()
        out = []
        if len(pairs):
            side = pairs >> np.uint64(ID_BITS)
            starts = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
            best = n == np.repeat(np.maximum.reduceat(n, starts), np.diff(np.append(starts, len(n))))
        for run in found.itertuples():
            mine, records = _heads(run.heads, run.n_pairs)
            steps, links = _columns(run.body, run.n_records, "<u4", "<u4")
            rows, at = np.cumsum(steps, dtype=np.uint32), np.repeat(np.searchsorted(pairs, mine), records)
            sums = np.zeros((2, int(rows.max()) + 1), np.int64)
            links = links.astype(np.int64)
            np.add.at(sums[0], rows, links * best[at])
            np.add.at(sums[1], rows, links * n[at])
            there = np.flatnonzero(sums[1])
            out.append(pd.DataFrame({"row": run.row + there, "n_best": sums[0][there], "count_sum": sums[1][there]}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "n_best": [], "count_sum": []}, dtype="int64")

    copies = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    runs_of = parts.select("radix", "salt", "row", "n_pairs", "n_records", "heads", "body").groupBy("radix", "salt")
    return runs_of.cogroup(copies.groupBy("radix", "salt")).applyInPandas(back, "row long, n_best long, count_sum long") \
        .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, a_path: str, b_path: str, merged_bytes: int = MERGED_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    Byte offsets at which tokens of both sides end cut a text's tokens into groups; tokens of a group are linked. A pair's count is the
    number of rows that hold it linked. n_best counts links whose count is the highest of their A id, count_sum adds up the counts of all.
    Null and empty texts, and texts that the tokens of a side do not spell with a space before, have zeros and an empty
    digest. Each row is a document of its own, repeated rows and null ids too; an empty table gives no rows; other
    columns are left out. The runs of a radix are split by task as the data grows (``merged_bytes``), so a frequent id is no hot key.
    """
    all_rows = stored(tokenized(docs, a_path, b_path), "runs")
    runs_only = all_rows.where("radix IS NOT NULL")
    size = runs_only.agg(F.sum(F.octet_length("heads") + F.octet_length("body"))).first()[0] or 0
    salts = max(1, -(-size // (merged_bytes << RADIX_BITS)))
    parts = runs_only.withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(salts)).cast("int"))
    totals = stored(counted(parts), "pairs")
    gains = gained(parts, totals, salts)
    nothing = F.lit(0).cast("long")
    return all_rows.where("radix IS NULL").join(gains, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", nothing).alias("n_best"), F.coalesce("count_sum", nothing).alias("count_sum"), "groups_sha256")
