"""A stored index of vectors in lists around trained centres, searched through the lists near a query (VS4)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.vector import SCORE_DIGITS, best_hits, topk_search, topk_stream, unit_matrix
from corpusflow.operators.product import measure, sliced_product, streamed_product
from corpusflow.operators.retrieve import BLOCK_ROWS, stream_blocks
from corpusflow.session import cut_lineage

#: Independent sets of lists. Two vectors that one set parts are often together in another, so several with a small share
#: each find more than one with a large share.
TABLES = 6
#: Lists of a table per square root of the rows, and their most: centres go to every task, at most MAX_LISTS * TABLES vectors.
LISTS_PER_ROOT, MAX_LISTS = 4.0, 16_384
#: Vectors that centres are trained on.
SAMPLE_ROWS = 1 << 18
#: Share of the rows that a query is compared with, all tables together.
READ_SHARE = 0.2
#: Cosines of queries and centres that are held at once, and bytes of a slice of queries with the bitmaps of their lists.
CELLS, SLICE_BYTES = 1 << 19, 64 * 1024 * 1024
ROUNDS = 8


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(unit centres, number of the nearest one for each row of unit vectors x)."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    near = np.zeros(len(x), np.int64)
    for _ in range(ROUNDS):
        near = nearest(x, centres)[0]
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(near[order]) > 0))
        sums = np.add.reduceat(x[order], first, axis=0)
        length = np.linalg.norm(sums, axis=1)
        good = length > 0
        centres[near[order][first][good]] = sums[good] / length[good, None]
    return centres, near


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, cosine to it) of each row, some rows at a time."""
    best, cosine = np.zeros(len(x), np.int64), np.zeros(len(x))
    step = max(1, (1 << 22) // max(1, len(centres)))
    for at in range(0, len(x), step):
        scores = x[at:at + step] @ centres.T
        best[at:at + step] = scores.argmax(axis=1)
        cosine[at:at + step] = scores.max(axis=1)
    return best, cosine


def train_lists(x: np.ndarray, lists: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(centres, number of the coarse centre of each): coarse centres first, then lists inside each, by its share of the vectors."""
    rng = np.random.default_rng(seed)
    coarse, near = _k_means(x, max(1, round(lists ** 0.5)), rng)
    centres, parts = [], []
    for part in range(len(coarse)):
        inside = x[near == part]
        if len(inside):
            found, _ = _k_means(inside, max(1, round(lists * len(inside) / len(x))), rng)
            centres.append(found)
            parts.append(np.full(len(found), part))
    return np.concatenate(centres), np.concatenate(parts)


@dataclass(frozen=True)
class VectorIndex:
    """Index below ``path``: rows/part=<n> holds the vectors sorted by list, lists the centres and what is known of each list."""

    spark: SparkSession
    path: str
    schema: T.StructType

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def lists(self) -> pd.DataFrame:
        """tbl, list, part, n, least (cosine of the farthest row to the centre), centre: bounded by MAX_LISTS and TABLES."""
        return self.spark.read.parquet(f"{self.path}/lists").orderBy("tbl", "list").toPandas()


def build_index(chunks: DataFrame, path: str, tables: int = TABLES, lists: int | None = None, seed: int = 7) -> VectorIndex:
    """VS4 (index): every row with a vector is stored once per table, in the list of its nearest centre.

    Centres are trained on at most SAMPLE_ROWS rows chosen by hash. Rows without a usable vector are left out.
    """
    spark = chunks.sparkSession
    usable = chunks.filter(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
    n = usable.count()
    lists = min(MAX_LISTS, max(1, lists or round(LISTS_PER_ROOT * n ** 0.5)))
    draw = F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1 << 30)) < (1 << 30) * SAMPLE_ROWS / max(1, n)
    sample = usable.filter(draw).select("embedding").limit(2 * SAMPLE_ROWS).withColumn("tbl", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))

    def train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        centres, parts = train_lists(unit_matrix(rows["embedding"])[0], lists, seed + key[0])
        return pd.DataFrame({"tbl": key[0], "list": np.arange(len(centres)), "part": key[0] * lists + parts, "centre": list(centres.astype("f4"))})

    centres = sample.groupBy("tbl").applyInPandas(train, "tbl int, list int, part int, centre array<float>").toPandas()
    by_table = {t: (unit_matrix(c["centre"])[0], c["part"].to_numpy()) for t, c in centres.sort_values(["tbl", "list"]).groupby("tbl")}
    shared = spark.sparkContext.broadcast(by_table)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, _ = unit_matrix(batch["embedding"])
            for t, (of_table, part) in shared.value.items():
                near, cosine = nearest(x, of_table)
                yield batch.assign(tbl=t, list=near, cosine=cosine, part=part[near])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in usable.dtypes)
    placed = usable.mapInPandas(place, f"{kinds}, tbl int, list int, cosine double, part int")
    # a list that holds many copies is split over files by adaptive execution
    placed.hint("rebalance", "part").sortWithinPartitions("part", "list").write.partitionBy("part").parquet(f"{path}/rows")
    index = VectorIndex(spark, path, placed.schema)
    known = index.rows().groupBy("tbl", "list").agg(F.count("*").alias("n"), F.min("cosine").alias("least"))
    centre = spark.createDataFrame(centres, "tbl int, list int, part int, centre array<float>")
    centre.join(known, ["tbl", "list"]).coalesce(1).write.parquet(f"{path}/lists")
    spark.createDataFrame([(placed.schema.json(),)], "value string").coalesce(1).write.text(f"{path}/_schema")
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(spark, path, T.StructType.fromJson(json.loads(spark.read.text(f"{path}/_schema").first()[0])))


def _searched(index: VectorIndex, read_share: float, one_table: bool) -> tuple[pd.DataFrame, float]:
    """(lists that a search looks at, rows that a query may read; infinite if there is no bound).

    Without a bound one table is enough, since each table holds every row: with ``one_table`` the one whose lists are the narrowest.
    """
    known = index.lists()
    tables = max(1, known["tbl"].nunique())
    budget = read_share * known["n"].sum() / tables
    if len(known) and read_share >= tables:
        budget = np.inf
        if one_table:
            wide = (known["n"] * np.arccos(known["least"].clip(-1, 1))).groupby(known["tbl"]).sum()
            known = known[known["tbl"] == wide.idxmin()].reset_index(drop=True)
    return known, budget


def _bits(known: pd.DataFrame) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """(bit of each list in the bitmap of a query, first byte and bytes of each table); tables begin with a byte of their own."""
    bits, of_table, first = np.zeros(len(known), np.int64), {}, 0
    for t, at in known.groupby("tbl").indices.items():
        bits[at] = first * 8 + np.arange(len(at))
        of_table[t] = first, -(-len(at) // 8)
        first += of_table[t][1]
    return bits, of_table


def _nearest_within(cosine: np.ndarray, may: np.ndarray, n: np.ndarray, budget: float, most: int) -> np.ndarray:
    """Mask of the nearest lists of each row that hold ``budget`` rows together, at least one; ``most`` are sorted at first."""
    chosen = np.zeros(cosine.shape, bool)
    rows, masked = np.arange(len(cosine)), np.where(may, cosine, -2.0)
    while len(rows):
        some = masked[rows]
        if most < cosine.shape[1]:
            order = np.sort(np.argpartition(-some, most - 1, axis=1)[:, :most], axis=1)
            order = np.take_along_axis(order, np.argsort(-np.take_along_axis(some, order, 1), axis=1, kind="stable"), 1)
        else:
            order = np.argsort(-some, axis=1, kind="stable")
        sizes = np.where(np.take_along_axis(may[rows], order, 1), n[order], 0)
        total = np.cumsum(sizes, axis=1)
        within = ((total <= budget) | (np.arange(order.shape[1]) == 0)) & (sizes > 0)
        of_rows = np.zeros(some.shape, bool)
        np.put_along_axis(of_rows, order, within, 1)
        chosen[rows] = of_rows
        if most >= cosine.shape[1]:
            break
        # a list as near as the last sorted one, or farther, may come next
        values = np.take_along_axis(some, order, 1)
        ends = np.take_along_axis(values, np.minimum(within.sum(axis=1), most - 1)[:, None], 1)[:, 0]
        rows, most = rows[(ends == values[:, -1]) & (ends > -2)], min(cosine.shape[1], 4 * most)
    return chosen


def probes(queries: DataFrame, index: VectorIndex, min_score: float, read_share: float = READ_SHARE, one_table: bool = False) -> DataFrame:
    """query_id, embedding, lists (a bit for each list, see ``_bits``), parts and n_read of each query with a vector.

    A list is left out if no row of it can reach ``min_score``: its rows lie within a known angle of the centre. Of the
    others, of all tables, the nearest are searched that hold the share of the rows together, and at least one. If the share
    leaves none out, ``one_table`` takes the lists of one table, which hold every row.
    """
    known, budget = _searched(index, read_share, one_table)
    of_table = [c.index.to_numpy() for _, c in known.groupby("tbl")]
    # the rounding of scores and of 32-bit centres is allowed for
    reach = np.arccos(np.clip(known["least"].to_numpy(np.float64), -1, 1)) + np.arccos(np.clip(min_score - 1e-4, -1, 1))
    needed = np.where(reach >= np.pi, -np.inf, np.cos(np.minimum(reach, np.pi)))
    shared = index.spark.sparkContext.broadcast([known["n"].to_numpy(), known["part"].to_numpy(), needed, unit_matrix(known["centre"])[0]])
    most = max(1, int(1.5 * min(1.0, budget / max(1, known["n"].sum())) * len(known)) + 16)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, part, needed, centres = shared.value
        step = max(1, min(256, CELLS // max(1, len(n))))
        order = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.diff(part[order], prepend=-1))
        names = part[order][first].astype(np.int32)
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.iloc[at:at + step]
                x, usable = unit_matrix(batch["embedding"])
                batch, x = batch[usable], x[usable]
                if not len(batch) or not len(n):
                    continue
                cosine = x @ centres.T
                may = cosine >= needed
                chosen = may if budget == np.inf else _nearest_within(cosine, may, n, budget, most)
                of_part = np.logical_or.reduceat(chosen[:, order], first, axis=1)
                packed = np.concatenate([np.packbits(chosen[:, at], axis=1) for at in of_table], axis=1)
                yield pd.DataFrame({"query_id": batch["query_id"].to_numpy(), "embedding": batch["embedding"].to_numpy(),
                                    "lists": [row.tobytes() for row in packed],
                                    "parts": [names[row] for row in of_part], "n_read": chosen @ n})

    kind = dict(queries.dtypes)["query_id"]
    return queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")) \
        .mapInPandas(choose, f"query_id {kind}, embedding array<double>, lists binary, parts array<int>, n_read long")


def search_index(queries: DataFrame, index: VectorIndex, k: int = 5, min_score: float = 0.7, read_share: float = READ_SHARE) -> DataFrame:
    """VS4: (query_id, chunk_id, score, rn), the best k rows in the lists near a query. With ``read_share`` >= 1 * tables all
    lists of a table that can hold a hit are searched, and the result is exact.

    Only the parts that some query probes are read (a partition filter in the scan). Queries have a bitmap of their lists, and
    a row counts for the queries of its list alone. With a bound on the rows read, queries go to the tasks in bounded slices, of
    several slices each with the lists of one table; without, many queries stay in blocks and the rows pass by.
    """
    asked = cut_lineage(probes(queries, index, min_score, read_share, True))  # read for the parts, for its size and in slices
    known, budget = _searched(index, read_share, True)
    numbers, (bits, of_table) = (known["tbl"] * (1 << 16) + known["list"]).to_numpy(), _bits(known)
    parts = [r[0] for r in asked.select(F.explode("parts")).distinct().collect()]  # at most as many as there are folders
    rows = index.rows().where(F.col("part").isin(parts)).select("chunk_id", (F.col("tbl") * (1 << 16) + F.col("list")).alias("grp"), "embedding", "tbl")
    asking = asked.select("query_id", "embedding", "lists")
    one = index.rows().where(F.col("tbl") == int(known["tbl"].min() if len(known) else 0))
    once_a_table = one.groupBy("chunk_id").count().filter("count > 1 OR chunk_id IS NULL").isEmpty()

    def bit_of(group: int) -> int:
        return int(bits[np.searchsorted(numbers, group)])

    def asked_from(first: int):
        class Asked:
            """The rows of the small side that ask for a list, read from its column of the bitmaps, which begin with the byte ``first``."""

            def __init__(self, small: pd.DataFrame):
                self.bits = np.frombuffer(b"".join(small["lists"]), np.uint8).reshape(len(small), -1) if len(small) else np.zeros((0, 0), np.uint8)

            def get(self, group: int) -> np.ndarray | None:
                at = int(np.searchsorted(numbers, group))
                if not len(self.bits) or at == len(numbers) or numbers[at] != group:
                    return None
                bit = int(bits[at]) - 8 * first
                return np.flatnonzero(self.bits[:, bit >> 3] & (128 >> (bit & 7)))

        if once_a_table:
            Asked.table_of = staticmethod(lambda group: group >> 16)
        return Asked

    best = best_hits(k, ["query_id"])
    types = dict(queries.dtypes)["query_id"], dict(index.rows().dtypes)["chunk_id"]
    schema = f"query_id {types[0]}, chunk_id {types[1]}, grp int, score double"

    def sliced(rows: DataFrame, small: DataFrame, first: int) -> DataFrame:
        return sliced_product(rows.drop("tbl"), small, topk_search(k, min_score, "own", asked_from(first), budget == np.inf), schema,
                              lambda hits: best(hits.drop_duplicates(["query_id", "chunk_id"])), max_bytes=SLICE_BYTES, block_rows=BLOCK_ROWS)

    count, size = measure(asking)
    blocks = stream_blocks(index.spark, count, size, k) if budget == np.inf else 0
    if blocks:
        hits = streamed_product(rows.drop("tbl"), asking, blocks, topk_stream(k, min_score, distinct=True, bit_of=bit_of), f"{schema}, rn int").drop("rn")
    elif size <= SLICE_BYTES or len(of_table) < 2:
        hits = sliced(rows, asking, 0)
    else:
        hits = None
        for t, (first, width) in of_table.items():
            of = sliced(rows.where(F.col("tbl") == int(t)), asking.withColumn("lists", F.substring("lists", first + 1, width)), first)
            hits = of if hits is None else hits.unionByName(of)
    # a row that several tables found counts once
    once = hits.groupBy("query_id", "chunk_id").agg(F.max(F.round("score", SCORE_DIGITS)).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return once.withColumn("rn", place).filter(F.col("rn") <= k)


def share_read(queries: DataFrame, index: VectorIndex, min_score: float, read_share: float = READ_SHARE) -> DataFrame:
    """Mean share of the indexed rows that a query is compared with; a row in the lists of two tables counts twice."""
    known = index.lists()
    total = int(known["n"].sum() // max(1, known["tbl"].nunique()))
    return probes(queries, index, min_score, read_share).agg((F.avg("n_read") / max(1, total)).alias("share"))
