"""Token ids in directly addressable codes: any token is read without decoding its neighbours.

File format (a Parquet folder ``blocks`` and a small one ``parts``, so any store that Spark writes to will do): a row of
``blocks`` holds the ids of consecutive documents. Ids are split into 8-bit chunks, lowest first, one level per chunk:

* ``chunks``: a byte for each id that reaches the level;
* ``more``: a bit for each of these (highest bit of a byte first), 1 if the id goes on at the next level;
* ``ranks``: little-endian unsigned 32-bit counts of the 1 bits before each group of 512.

The chunk of id i at the next level stands at the number of 1 bits before i. Documents are in ascending order of doc_id
(nulls first; equal ids by the hash of the text) through partitions, blocks and rows; a document lies in one block.
``parts`` holds the number of ids before each partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm.segments import byte_encoder_of

#: A block is closed when it holds so many ids.
BLOCK_IDS = 1 << 18
GROUP_BITS = 512
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)

LEVEL = "struct<chunks: binary, more: binary, ranks: binary>"
BLOCKS = ("part int, block int, part_start long, n_ids long, doc_ids array<long>, doc_starts array<long>, "
          f"levels array<{LEVEL}>")
_ARROW_LEVEL = pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("levels", pa.list_(_ARROW_LEVEL))])


def to_levels(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of an array of unsigned 32-bit ids; none for no ids."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest):
        more = rest > 0xFF
        bits = np.packbits(more)
        per_group = np.add.reduceat(_ONES[bits], np.arange(0, len(bits), GROUP_BITS // 8))
        ranks = np.append(0, np.cumsum(per_group)[:-1]).astype("<u4")
        levels.append({"chunks": rest.astype(np.uint8).tobytes(), "more": bits.tobytes(), "ranks": ranks.tobytes()})
        rest = rest[more] >> 8
    return levels


def from_levels(levels) -> np.ndarray:
    """All ids of a block."""
    if not levels:
        return np.zeros(0, dtype="<u4")
    out = np.frombuffer(levels[0]["chunks"], dtype=np.uint8).astype("<u4")
    at = None
    for depth, level in enumerate(levels[1:], 1):
        bits = np.unpackbits(np.frombuffer(levels[depth - 1]["more"], dtype=np.uint8), count=len(levels[depth - 1]["chunks"]))
        more = np.flatnonzero(bits)
        at = more if at is None else at[more]
        out[at] |= np.frombuffer(level["chunks"], dtype=np.uint8).astype("<u4") << np.uint32(8 * depth)
    return out


def access(levels, i: int) -> int:
    """The id at place i, from a byte, a bit and a rank at each level."""
    out = 0
    for depth, level in enumerate(levels):
        out |= level["chunks"][i] << (8 * depth)
        byte, bit = divmod(i, 8)
        if not level["more"][byte] >> (7 - bit) & 1:
            break
        group = i // GROUP_BITS
        rank = int.from_bytes(level["ranks"][4 * group:4 * group + 4], "little")
        first = group * GROUP_BITS // 8
        rank += int(_ONES[np.frombuffer(level["more"], np.uint8, byte - first, first)].sum())
        i = rank + int(_ONES[level["more"][byte] >> (8 - bit)])
    return out


def write_codes(docs: DataFrame, folder: str, path: str, end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write the two tables below ``folder``.

    Repeated rows are documents of their own; an empty table gives empty tables; other columns are left out. The order
    is made by range partitioning on (doc_id, hash of the text), so that one hot doc_id is spread as well.
    """
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(n, *order) \
        .sortWithinPartitions(*order).select("doc_id", "text")
    end = np.array([end_id], dtype="<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = byte_encoder_of(path), TaskContext.get().partitionId()
        block = before = 0
        held, names, starts, size = [], [], [], 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            row = {"part": part, "block": block, "part_start": before, "n_ids": len(ids), "doc_ids": list(names),
                   "doc_starts": list(starts), "levels": to_levels(ids)}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder(some.column(1).to_pylist())):
                    names.append(doc_id)
                    starts.append(size)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= block_ids:
                        yield closed()
                        block, before = block + 1, before + size
                        held, names, starts, size = [], [], [], 0
        if names:
            yield closed()

    ranged.mapInArrow(blocks, BLOCKS).write.parquet(f"{folder}/blocks")
    # one row per partition of the write above, whatever the corpus holds
    totals = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals.select("part", F.coalesce(before, F.lit(0)).alias("base"), "n").write.parquet(f"{folder}/parts")


def read_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with ``start``, the ids before the block; ``parts`` has at most a row for each partition of the write."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    parts = spark.read.parquet(f"{folder}/parts").select("part", "base")
    return blocks.join(F.broadcast(parts), "part").withColumn("start", F.col("base") + F.col("part_start"))


def documents_of(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the blocks."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = from_levels(row["levels"]).tobytes()
                starts = row["doc_starts"]
                ends = [*starts[1:], row["n_ids"]]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array([row["start"] + s for s in starts], pa.int64()),
                    "n_tokens": pa.array([e - s for s, e in zip(starts, ends)], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(starts, ends)], pa.int64())})

    return blocks.select("doc_ids", "doc_starts", "n_ids", "start", "levels").mapInArrow(
        digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(spark: SparkSession, folder: str, places: DataFrame) -> DataFrame:
    """The id at each ``place`` (long) of the whole stream; places outside it give no row, repeated ones a row each."""
    parts = spark.read.parquet(f"{folder}/parts")
    blocks = read_codes(spark, folder).select("part", "start", "n_ids", "levels")
    p = places.select("place").join(F.broadcast(parts), (F.col("place") >= F.col("base")) & (F.col("place") < F.col("base") + F.col("n")))
    hit = p.select("place", "part").join(blocks, "part").where("place >= start AND place < start + n_ids")
    return hit.select("place", _access(F.col("levels"), F.col("place") - F.col("start")).alias("token_id"))


def _access(levels: Column, i: Column) -> Column:
    @F.arrow_udf("long")
    def token(levels: pa.Array, i: pa.Array) -> pa.Array:
        return pa.array([access(x.as_py(), j.as_py()) for x, j in zip(levels, i)], pa.int64())

    return token(levels, i)
