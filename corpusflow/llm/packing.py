"""First-fit decreasing packing of token sequences with a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.segments import word_encoder_of

#: Tokens of a sequence.
CAPACITY = 4096
#: Documents of a packing group, on average.
GROUP_DOCUMENTS = 2_048

PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class TournamentTree:
    """Room left in bins; each inner node knows the most room below it, so the first bin that fits is one walk down."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1
        self.room = [0, capacity]
        self.used = 0

    def place(self, size: int) -> tuple[int, int]:
        """Bin and offset of an item in the first bin with room for it; an untouched bin has all room."""
        if self.room[1] < size:
            self._double()
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        where, offset = node - self.leaves, self.capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        self.used = max(self.used, where + 1)
        return where, offset

    def _double(self) -> None:
        """Twice the bins: the tree so far becomes the left half."""
        old, n = self.room, self.leaves
        new = [0] * (4 * n)
        level = 1
        while level <= n:
            new[2 * level:3 * level] = old[level:2 * level]
            new[3 * level:4 * level] = [self.capacity] * level
            level *= 2
        new[1] = self.capacity
        self.room, self.leaves = new, 2 * n


def pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: ids of each whole text and the end id, cut at multiples of the capacity.

    A null text counts as empty and gives the end id alone. Repeated rows are documents of their own.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    @F.pandas_udf("starts array<long>, lengths array<long>, crcs array<long>, n long")
    def cut(texts: pd.Series) -> pd.DataFrame:
        encoder, out = word_encoder_of(path), []
        for at in range(0, len(texts), 256):
            for ids in encoder(texts.iloc[at:at + 256]):
                ids += end
                n = len(ids) // 4
                starts = list(range(0, n, capacity))
                parts = [ids[4 * s:4 * (s + capacity)] for s in starts]
                out.append((starts, [len(p) // 4 for p in parts], [zlib.crc32(p) for p in parts], n))
        return pd.DataFrame(out, columns=["starts", "lengths", "crcs", "n"])

    each = docs.select("doc_id", cut("text").alias("c")).select(
        "doc_id", "c.n", F.explode(F.arrays_zip("c.starts", "c.lengths", "c.crcs")).alias("p"))
    return each.select("doc_id", F.col("p.starts").alias("start"), F.col("p.lengths").alias("length"),
                       F.col("p.crcs").alias("ids_crc32"), F.col("n").alias("doc_tokens"))


def pack(cut: DataFrame, n_documents: int, capacity: int = CAPACITY, group_documents: int = GROUP_DOCUMENTS,
         seed: int = 17) -> DataFrame:
    """The pieces with sequence_id and offset: first-fit decreasing in each group.

    The group of a piece is a seeded hash of its document, so groups are random samples of equal expected size and a
    piece stays in its group when a task is repeated. Spark sorts the pieces of a group by falling length (ties by
    document and start); a task reads them as a stream and holds the room of the bins of one group, never the pieces.
    The number of groups follows the number of documents. ``sequence_id`` is group * 2^32 + bin.
    """
    groups = max(1, -(-n_documents // group_documents))
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"), F.lit(groups)))
    ordered = dealt.repartition("grp").sortWithinPartitions(
        "grp", F.desc("length"), F.col("doc_id").asc_nulls_first(), "start", "ids_crc32")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, tree = None, None
        for batch in batches:
            ids, offsets = [], []
            for g, length in zip(batch.column("grp").to_pylist(), batch.column("length").to_pylist()):
                if g != group:
                    group, tree = g, TournamentTree(capacity)
                where, offset = tree.place(length)
                ids.append((g << 32) + where)
                offsets.append(offset)
            kept = [batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.record_batch([*kept, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())],
                                  names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ordered.mapInArrow(fill, PACKED)


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY,
                   group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """Every document in sequences of at most ``capacity`` tokens; a row per piece (columns in ``PACKED``).

    An empty table gives no rows; other columns are left out. Sequences are filled from offset 0 without gaps.
    """
    return pack(pieces(docs, path, end_id, capacity), docs.count(), capacity, group_documents)
