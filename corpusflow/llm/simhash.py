"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two 64-bit fingerprints at most 4 bits apart share at least 4 of their 8 positional bytes. Lists of one positional byte
would hold a 256th of all fingerprints each, so lists stand under three positional bytes: ``byte_triples`` are 20 triples of
positions of which any 4 positions contain one, hence every pair that shares 4 bytes meets in a list. In a list the shared
bytes of each pair are tallied, pairs below the guaranteed count go, and the rest are verified by their differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.components import components
from corpusflow.llm.storage import stored

WORDS = 4
SEED = 42
MAX_BITS = 4
#: Fingerprints of a list that are compared in one piece; longer lists are cut into blocks, each pair of blocks on its own.
BLOCK = 2_048
#: Groups up to this size are compared pair by pair, larger ones by growing trees.
PAIRWISE = 16


def fingerprint_of(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of one whole text; 0 without words."""
    import xxhash

    parts = (text or "").encode().lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.append(0, ends[:-1])
    k = min(words, len(parts))
    n = len(parts) - k + 1
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at:min(n, at + (1 << 16))].tolist(), (ends[at + k - 1:at + k - 1 + (1 << 16)] - 1).tolist())
        raw = b"".join([digest(joined[a:b], seed) for a, b in spans])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprint(text: Column | str, words: int = WORDS, seed: int = SEED) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, words, seed) for t in texts], dtype="int64")

    return of(text)


def byte_triples() -> list[tuple[int, int, int]]:
    """The positions in three sets: triples inside a set, or two of a set and one of the next."""
    sets = [(0, 1, 2), (3, 4, 5), (6, 7)]
    inside = [t for s in sets for t in combinations(s, 3)]
    across = [(*two, one) for i, s in enumerate(sets) for two in combinations(s, 2) for one in sets[(i + 1) % 3]]
    return inside + across


def _lists(nodes: DataFrame) -> DataFrame:
    """(key, fp) for each triple of positional bytes."""
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = [F.lit(i) * (1 << 24) + byte[a] * 65536 + byte[b] * 256 + byte[c] for i, (a, b, c) in enumerate(byte_triples())]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key"))


def _matches(mine: np.ndarray, others: np.ndarray, max_bits: int) -> np.ndarray:
    """Tally the shared positional bytes, keep the pairs that reach the guaranteed count, verify their bits."""
    differing = mine ^ others
    shared = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    hit = shared >= 8 - max_bits
    hit[hit] = np.bitwise_count(differing[hit]) <= max_bits
    return hit


def _forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep every connection inside the list: at most one fewer than fingerprints."""
    left, a, b = fps.copy(), [], []
    while len(left):
        reached, left = [left[:1]], left[1:]
        while reached and len(left):
            wave = reached.pop()
            for fp in wave:
                hit = _matches(np.uint64(fp), left, max_bits)
                if hit.any():
                    new = left[hit]
                    a.append(np.full(len(new), fp))
                    b.append(new)
                    reached.append(new)
                    left = left[~hit]
                    if not len(left):
                        break
    none = np.zeros(0, np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def _links_of(group: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal ``group``; a fingerprint may stand twice in a run (it is in both blocks only once)."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    a, b = [], []
    small = np.repeat(sizes <= PAIRWISE, sizes)
    g, f = group[small], fps[small]
    for shift in range(1, min(PAIRWISE, int(sizes[sizes <= PAIRWISE].max(initial=1)))):
        same = g[:-shift] == g[shift:]
        left, right = f[:-shift][same], f[shift:][same]
        hit = _matches(left, right, max_bits)
        a.append(left[hit])
        b.append(right[hit])
    for at in np.flatnonzero(sizes > PAIRWISE):
        found = _forest(fps[starts[at]:starts[at] + sizes[at]], max_bits)
        a.append(found[0])
        b.append(found[1])
    none = np.zeros(0, np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def links(nodes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that keep all connections at ``max_bits`` (at most 4).

    No list is met whole when it is long: its fingerprints are dealt into blocks, and each pair of blocks is a group of
    its own, so memory and task size are bounded and no pair is left out. A group returns a spanning forest, not its pairs.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the index guarantees pairs of at most 4 differing bits")
    lists = _lists(nodes)
    long = lists.groupBy("key").count().where(F.col("count") > block) \
        .select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tiles = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.transform(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("own")),
        lambda j: F.least(j, F.col("own")) * F.col("blocks") + F.greatest(j, F.col("own"))))
    dealt = lists.join(long, "key", "left").withColumn("own", own).select("key", F.explode(tiles).alias("tile"), "fp")
    grouped = dealt.repartition("key", "tile").sortWithinPartitions("key", "tile")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)

        def found(rows: np.ndarray) -> pa.RecordBatch:
            new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))
            a, b = _links_of(np.cumsum(new), np.ascontiguousarray(rows[:, 2]).view(np.uint64), max_bits)
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            rows = np.concatenate([held, rows])
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield found(rows[:cut])
            held = rows[cut:]
        if len(held):
            yield found(held)

    return grouped.mapInArrow(compare, "a long, b long")


def classes(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component_id, component_fp) of a stored table (doc_id, fp): least doc_id of the fingerprint's class.

    Copies meet in their fingerprint, aggregated before the shuffle, and are never paired. ``component_fp`` is the least
    fingerprint that has that doc_id in the class.
    """
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    rooted = components(links(nodes, max_bits)).withColumnRenamed("node", "fp")
    nodes = nodes.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = nodes.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("m"))
    return nodes.join(best, "root").select("fp", F.col("m.least").alias("component_id"), F.col("m.fp").alias("component_fp"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows each get a row; a class
    whose ids are all null has the component null; an empty table gives no rows; other columns are left out.
    """
    prints = stored(docs.select("doc_id", fingerprint("text", words).alias("fp")), "prints")
    return prints.join(classes(prints, max_bits), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, max_bits: int = MAX_BITS, words: int = WORDS) -> DataFrame:
    """One row of each class, the one with the least doc_id (nulls last), with all its columns."""
    marked = stored(docs.withColumn("__fp", fingerprint("text", words)), "marked")
    prints = marked.select("doc_id", F.col("__fp").alias("fp"))
    first = classes(prints, max_bits).select(F.col("component_id").alias("__id"), F.col("component_fp").alias("__first")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__first"))
    return marked.join(first, same, "left_semi").dropDuplicates(["doc_id", "__fp"]).drop("__fp")
