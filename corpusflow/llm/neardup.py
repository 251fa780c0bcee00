"""Embedding near-duplicates: PCA-ordered tiled comparison with suffix-norm bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.components import components
from corpusflow.llm.storage import stored

THRESHOLD = 0.98
#: Vectors of a tile; a task holds two tiles.
TILE = 2_048
#: Leading dimensions after which pairs are tested.
STEPS = (8, 16, 32)
#: Pairs whose remaining products are taken at once.
PAIRS = 1 << 16
#: Rounding allowance of the bounds; the decision itself is made on the vectors as they came.
SLACK = 1e-9


def usable(embedding: Column | str) -> Column:
    """True for vectors with components, all finite, not all zero; else false."""
    v = F.col(embedding) if isinstance(embedding, str) else embedding
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce((F.size(v) > 0) & fine, F.lit(False))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Axes of falling variance for each vector size, from the moments of all vectors.

    Tasks add up their moments; sums of size d * d per vector size reach the driver, whatever the number of vectors.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, x in _by_size(batch.column(0)):
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                sums[size] = sums.get(size, 0) + unit.T @ unit
        for size, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size * size, size)), pa.array(np.arange(size * size)), pa.array(s.ravel())],
                                             ["size", "cell", "s"])

    rows = vectors.select("embedding").mapInArrow(moments, "size long, cell long, s double").groupBy("size", "cell").agg(F.sum("s").alias("s"))
    axes = {}
    for size, cells in rows.toPandas().groupby("size"):
        matrix = np.zeros(size * size)
        matrix[cells["cell"]] = cells["s"]
        axes[int(size)] = np.linalg.eigh(matrix.reshape(size, size))[1][:, ::-1]
    return axes


def _by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths)
    for size in np.unique(lengths).tolist():
        at = (ends[lengths == size] - size)[:, None] + np.arange(size)
        yield size, values[at]


def _linked(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of x and y at or above the threshold."""
    nx, ny = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
    u, v = (x / nx[:, None]) @ axes, (y / ny[:, None]) @ axes
    size = x.shape[1]
    rest_u, rest_v = (np.sqrt(np.maximum(0, np.cumsum((w * w)[:, ::-1], axis=1)[:, ::-1])) for w in (u, v))
    steps = [k for k in STEPS if k < size]
    first = steps[0] if steps else size
    products = u[:, :first] @ v[:, :first].T
    bound = products + (np.outer(rest_u[:, first], rest_v[:, first]) if first < size else 0)
    all_i, all_j = np.nonzero(bound >= threshold - SLACK)
    out = []
    for at in range(0, len(all_i), PAIRS):
        i, j = all_i[at:at + PAIRS], all_j[at:at + PAIRS]
        done, so_far = products[i, j], first
        for k in [*steps[1:], size]:
            done = done + np.einsum("ij,ij->i", u[i, so_far:k], v[j, so_far:k])
            may = done + (rest_u[i, k] * rest_v[j, k] if k < size else 0) >= threshold - SLACK
            i, j, done, so_far = i[may], j[may], done[may], k
        sure = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j]) >= threshold
        out.append((i[sure], j[sure]))
    return tuple(np.concatenate(z) if z else np.zeros(0, np.int64) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between n rows, enough to keep all connections."""
    order = np.argsort(np.append(i, j), kind="stable")
    ends = np.append(j, i)[order]
    first = np.searchsorted(np.append(i, j)[order], np.arange(n + 1))
    seen, a, b = np.zeros(n, bool), [], []
    for start in np.unique(np.append(i, j)).tolist():
        if seen[start]:
            continue
        seen[start] = True
        todo = [start]
        while todo:
            at = todo.pop()
            near = ends[first[at]:first[at + 1]]
            new = np.unique(near[~seen[near]])
            seen[new] = True
            a += [at] * len(new)
            b += new.tolist()
            todo += new.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def compared(nodes: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(a, b, n) of stored nodes (node long, label, embedding array<double>, copies long).

    Rows with b are links that keep all connections; rows without b say that node a has links to n more vectors, copies
    counted. Nodes are ordered along the first axis of their label: strips as wide as two linked vectors can be apart,
    dealt into tiles of bounded size, so only tiles of one strip or of neighbouring strips are compared. A pair of tiles
    is a group of its own; what a group returns grows with its vectors, not with its links.
    """
    axes = principal_axes(nodes)
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    spark = nodes.sparkSession
    first = {size: matrix[:, 0].tolist() for size, matrix in axes.items()}
    if not first:
        return spark.createDataFrame([], "a long, b long, n long")

    @F.pandas_udf("int")
    def strip(vectors: pd.Series) -> pd.Series:
        return pd.Series([int(np.floor(np.dot(v, first[len(v)]) / np.sqrt(np.dot(v, v)) / width)) for v in vectors], dtype="int32")

    placed = stored(nodes.withColumn("size", F.size("embedding")).withColumn("strip", strip("embedding")), "placed")
    place = ["label", "size", "strip"]
    counts = placed.groupBy(*place).count().select(*place, F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    beside = counts.select("label", "size", F.col("strip").alias("other"), F.col("tiles").alias("other_tiles"))
    beside = beside.withColumn("strip", F.explode(F.array(F.col("other"), F.col("other") - 1)))
    # strip meets itself and the next strip: (strip, tile i) with (other, tile j), each pair of tiles once
    pairs = counts.join(beside, place).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))) \
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1))).where("strip <> other OR i <= j")
    left = pairs.select(*place, F.col("i").alias("tile"), "i", "j", F.col("strip").alias("s"), "other", F.lit(True).alias("is_left"))
    right = pairs.where("strip <> other OR i <> j").select(
        "label", "size", F.col("other").alias("strip"), F.col("j").alias("tile"), "i", "j", F.col("strip").alias("s"), "other",
        F.lit(False).alias("is_left"))
    dealt = placed.join(counts, place).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    sent = dealt.join(left.union(right), [*place, "tile"])

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        alone = key[2] == key[3] and key[4] == key[5]
        one = rows if alone else rows[rows["is_left"]]
        two = rows if alone else rows[~rows["is_left"]]
        empty = pd.DataFrame({"a": [], "b": [], "n": []}).astype("Int64")
        if not len(one) or not len(two):
            return empty
        x, y = np.stack(one["embedding"].to_numpy()), np.stack(two["embedding"].to_numpy())
        i, j = _linked(x, y, axes[x.shape[1]], threshold)
        if alone:
            i, j = i[i < j], j[i < j]
        a, b = one["node"].to_numpy(), two["node"].to_numpy()
        ca, cb = one["copies"].to_numpy(), two["copies"].to_numpy()
        n_a = np.bincount(i, cb[j], minlength=len(a)).astype(np.int64)
        n_b = np.bincount(j, ca[i], minlength=len(b)).astype(np.int64)
        f, g = _forest(len(a) + (0 if alone else len(b)), i, j + (0 if alone else len(a)))
        names = a if alone else np.append(a, b)
        n, who = np.append(n_a, n_b), np.append(a, b)
        links = pd.DataFrame({"a": pd.array(names[f], "Int64"), "b": pd.array(names[g], "Int64"), "n": pd.array([None] * len(f), "Int64")})
        more = pd.DataFrame({"a": pd.array(who[n > 0], "Int64"), "b": pd.array([None] * int((n > 0).sum()), "Int64"), "n": pd.array(n[n > 0], "Int64")})
        return pd.concat([links, more])

    return sent.groupBy("label", "size", "s", "other", "i", "j").applyInPandas(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, label, embedding).

    Vectors link if their labels are equal, their sizes too, and their cosine in double precision is at least the
    threshold, whatever their lengths (components from 5e-324 to 1.8e308). A null label, a null, empty or zero vector, or one with null or non-finite components links with nothing
    and is its own component. Equal vectors are aggregated before anything is compared. Repeated rows are vectors of
    their own; a null vec_id is ignored as least id and kept only if nothing in its component has an id; an empty table
    gives no rows; other columns are left out.
    """
    # squares of very small or large components would vanish or overflow: such vectors are scaled, which no cosine sees
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    rows = vectors.select("vec_id", "label", "embedding").withColumn("fine", F.col("label").isNotNull() & usable("embedding")) \
        .withColumn("scale", F.when(largest.between(1e-100, 1e100), 1.0).otherwise(largest))
    wide = F.when(F.col("scale") == 1.0, F.col("embedding").cast("array<double>")) \
        .otherwise(F.transform("embedding", lambda x: x.cast("double") / F.col("scale")))
    distinct = rows.where("fine").groupBy("label", wide.alias("embedding")).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = stored(compared(nodes, threshold, tile), "compared")
    more = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    rooted = components(found.where("b IS NOT NULL").select("a", "b"))
    known = nodes.select("node", "label", "embedding", "least", "copies").join(rooted, "node", "left").join(more, "node", "left") \
        .withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select(
        "label", "embedding", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    linked = rows.where("fine").select("vec_id", "label", wide.alias("embedding")).join(known, ["label", "embedding"]) \
        .select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
