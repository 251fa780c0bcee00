"""Line deduplication: range-partitioned line hashes streamed in (hash, document, position) order; bitmaps come back, not text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.storage import stored

#: Keys with fewer code points are never dropped.
MIN_CHARS = 20
#: Documents that must hold a key.
MIN_DOCS = 3

# The white space that a key loses at both ends.
BLANK = " \t\n\x0b\x0c\r"

_PLACE = "high long, low long, has_id boolean, doc long, text_key long, pos int"
#: ``dropped``: a line that goes. ``open``: a line of a key that another partition may hold too, with the rank of its document
#: among those of the key here. ``part``: for such a key, the number of its documents here and the first and last of them.
_STREAMED = f"kind string, part int, rank long, first_has boolean, first_doc long, {_PLACE}"


def line_records(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each line whose key is long enough: 128-bit hash of the key, document, hash of its text, position."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, rows, places = bytearray(), [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for pos, line in enumerate((text or "").split("\n")):
                    key = line.strip(BLANK)
                    if len(key) >= min_chars:
                        digests += xxhash.xxh3_128_digest(key.encode().lower())  # of bytes, lower() changes A-Z only
                        rows.append(row)
                        places.append(pos)
            halves = np.frombuffer(bytes(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), *[batch.column(c).take(at) for c in ("has_id", "doc", "text_key")],
                 pa.array(places, pa.int32())], ["high", "low", "has_id", "doc", "text_key", "pos"])

    return _keyed(docs).select("text", "has_id", "doc", "text_key").mapInArrow(split, _PLACE)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with what names a document: its id, null below every id, and a hash of its text for rows of equal id."""
    return docs.select("doc_id", "text", F.col("doc_id").isNotNull().alias("has_id"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.xxhash64("text").alias("text_key"))


def _changes(columns: list[np.ndarray], before: tuple | None) -> np.ndarray:
    """Whether a row differs from the row above it, ``before`` being the row above the first."""
    changed = np.zeros(len(columns[0]), bool)
    for k, column in enumerate(columns):
        changed[1:] |= column[1:] != column[:-1]
        changed[0] |= before is None or column[0] != before[k]
    return changed


def _streamed(min_docs: int):
    """Sorted rows of a range partition, greatest document of a key first, to what is dropped and what the neighbours decide.

    The first document of a key keeps its lines; those of the others go once ``min_docs`` documents have been seen. Until
    then they are held, at most ``min_docs`` - 2 documents of one key.
    """
    names = ["high", "low", "has_id", "doc", "text_key", "pos"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: tuple | None = None  # the row above, the rank of its document, the first document of its key
        rank, first_doc = 0, None
        head = True  # the partition's first key still goes on
        held: list[pd.DataFrame] = []

        def out(frame: pd.DataFrame, kind: str) -> pa.RecordBatch:
            frame = frame.assign(kind=kind, part=part).reindex(columns=_schema().names)
            return pa.RecordBatch.from_pandas(frame, schema=_schema(), preserve_index=False)

        def summary(row: tuple, rank: int) -> pa.RecordBatch:
            return out(pd.DataFrame([dict(zip(names, row)) | {"rank": rank + 1, "first_has": first_doc[0], "first_doc": first_doc[1]}]), "part")

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            new_key = _changes(columns[:2], last and last[:2])
            new_doc = new_key | _changes(columns[2:4], last and last[2:4])
            repeated = ~(new_doc | _changes(columns[4:], last and last[4:]))
            # group 0 goes on from the batch before; the others start here
            count, group, starts = np.cumsum(new_doc), np.cumsum(new_key), np.flatnonzero(new_key)
            ranks = count - np.append(-rank, count[starts])[group]
            ends = np.append(starts - 1, len(ranks) - 1)
            reached = np.where(ends >= 0, ranks[ends], rank) >= min_docs - 1
            frame = pd.DataFrame(dict(zip(names, columns)) | {"rank": ranks})
            if last is None:
                first_doc = columns[2][0], columns[3][0]
            opening = 0 if last else 1
            first = (group == opening) & head
            if first.any():
                yield out(frame[first & ~repeated], "open")
            later = (ranks >= 1) & ~first & ~repeated
            if reached[0]:
                for one in held:
                    yield out(one, "dropped")
            if reached[0] or len(starts):
                held = []
            if (sure := later & reached[group]).any():
                yield out(frame[sure], "dropped")
            if (tail := later & (group == group[-1]) & ~reached[group]).any():
                held.append(frame[tail])
            if head and len(starts) > opening:
                end = starts[opening] - 1
                yield summary(last, rank) if end < 0 else summary(tuple(c[end] for c in columns), ranks[end])
                head = False
            if len(starts) and not head:
                first_doc = columns[2][starts[-1]], columns[3][starts[-1]]
            last, rank = tuple(c[-1] for c in columns), int(ranks[-1])
        if last:
            for one in held:
                yield out(one, "open")
            yield summary(last, rank)

    return stream


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, _STREAMED.split(", "))])


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(has_id, doc, text_key, pos) of the lines that go.

    The range partitions are cut by hash, document and position, so lines of one key, however many, spread over partitions.
    Only a partition's first and last key can reach into others: their counts, two rows a partition, are added up and
    broadcast to the rows of these keys.
    """
    order = ["high", "low", F.desc("has_id"), F.desc("doc"), "text_key", "pos"]
    records = stored(line_records(docs, min_chars), "lines")
    ranged = records.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(ranged.mapInArrow(_streamed(min_docs), _STREAMED), "streamed")
    key = Window.partitionBy("high", "low").orderBy("part")
    above = [F.lag(c).over(key) for c in ("has_id", "doc")]
    # a document that ends a partition may go on in the next
    goes_on = F.coalesce((above[0] == F.col("first_has")) & (above[1] == F.col("first_doc")), F.lit(False)).cast("long")
    parts = found.where("kind = 'part'").withColumn("goes_on", goes_on).withColumn("new", F.col("rank") - F.col("goes_on")).select(
        "high", "low", "part", (F.sum("new").over(key) - F.col("new") - F.col("goes_on")).alias("offset"),
        F.sum("new").over(Window.partitionBy("high", "low")).alias("n_docs"))
    place = ["has_id", "doc", "text_key", "pos"]
    shared = found.where("kind = 'open'").join(F.broadcast(parts), ["high", "low", "part"]) \
        .where((F.col("rank") + F.col("offset") >= 1) & (F.col("n_docs") >= min_docs))
    return found.where("kind = 'dropped'").select(*place).union(shared.select(*place))


def pack_bits(positions: list[int]) -> bytes:
    """Keep bits, in whole bytes up to the last dropped line (all later lines stay): a byte 0 and the bits, or a byte 1 and them in zstd."""
    keep = np.ones(-(-(max(positions) + 1) // 8) * 8, np.uint8)
    keep[positions] = 0
    raw = np.packbits(keep, bitorder="little").tobytes()
    small = zstandard.ZstdCompressor(level=3).compress(raw) if len(raw) > 32 else raw
    return b"\1" + small if len(small) < len(raw) else b"\0" + raw


def unpack_bits(packed: bytes | None, n_lines: int) -> np.ndarray:
    """Whether each of ``n_lines`` lines stays."""
    keep = np.ones(n_lines, bool)
    if packed:
        raw = zstandard.ZstdDecompressor().decompress(packed[1:]) if packed[0] else packed[1:]
        bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:n_lines]
        keep[:len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """has_id, doc, text_key, n_dropped, keep_bits of the documents that lose lines (``pack_bits`` tells the format)."""

    @F.pandas_udf("n_dropped long, keep_bits binary")
    def packed(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"n_dropped": column.map(len), "keep_bits": column.map(pack_bits)})

    return dropped_lines(docs, min_chars, min_docs).groupBy("has_id", "doc", "text_key") \
        .agg(packed(F.collect_set("pos")).alias("b")).select("has_id", "doc", "text_key", "b.*")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text, keep_bits (null: all lines stay). Texts are not sorted for it: bitmaps are the hashed side."""
    return _keyed(docs).join(bitmaps.hint("shuffle_hash"), ["has_id", "doc", "text_key"], "left").select("doc_id", "text", "keep_bits")


def kept_text(text: str | None, keep_bits: bytes | None) -> tuple[int, str]:
    """Number of lines before, and the lines that stay joined by line feeds."""
    lines = (text or "").split("\n")
    if not keep_bits:
        return len(lines), text or ""
    return len(lines), "\n".join(np.array(lines, dtype=object)[unpack_bits(keep_bits, len(lines))])


def without_repeats(text: Column | str, keep_bits: Column | str) -> Column:
    """The text without its dropped lines (null text: empty)."""

    @F.pandas_udf("string")
    def kept(texts: pd.Series, bits: pd.Series) -> pd.Series:
        return pd.Series([kept_text(t, b)[1] for t, b in zip(texts, bits)])

    return kept(text, keep_bits)


def deduplicate(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document.

    A key is a line without white space at its ends and with A-Z in lower case. Keys of ``min_chars`` code points or more
    in ``min_docs`` documents or more lose all their lines except in the greatest doc_id. Null and empty texts are one
    empty line. Rows with one doc_id are one document, also where their texts differ, and each row keeps or loses its own
    lines; null ids are one document, below all ids. One row per input row; an empty table gives none; other columns are
    left out.
    """

    @F.pandas_udf("n_lines long, n_dropped long, kept_sha256 string")
    def digests(texts: pd.Series, bits: pd.Series) -> pd.DataFrame:
        out = []
        for text, packed in zip(texts, bits):
            n, kept = kept_text(text, packed)
            out.append((n, n - int(unpack_bits(packed, n).sum()) if packed else 0, hashlib.sha256(kept.encode()).hexdigest()))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept_sha256"])

    return with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs)).select("doc_id", digests("text", "keep_bits").alias("d")).select("doc_id", "d.*")
