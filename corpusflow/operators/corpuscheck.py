"""Corpus checks: blocks, template swaps, repeated texts (CQ)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.scan import running_last, running_sum
from corpusflow.session import cut_lineage

# Corpus limits.
BLOCK_MIN = 64
MIN_BLOCKS = 30
SWAP_PREFIX = 40
SWAP_SHARE = 0.55


def label_blocks(lines: DataFrame, positive: str, negative: str) -> DataFrame:
    """CQ1: add ``block``; a new one starts where a positive line follows a negative one.

    lines(line, label, ...) with unique line numbers. Gaps and islands in two levels, so one
    long file does not end up in one task.
    """
    kept = lines.filter(F.col("label").isin(positive, negative))
    before = running_last(kept, [], "line", {"_prev": "label"}, inclusive=False)
    starts = before.withColumn("_start", F.when((F.col("label") == positive) & (F.col("_prev") == negative), 1).otherwise(0))
    return running_sum(starts, [], "line", "_start", "block").drop("_prev", "_start")


def block_completeness(blocks: DataFrame, positive: str, negative: str, minimum: int = BLOCK_MIN) -> DataFrame:
    """CQ1: positive and negative lines per block and whether both reach the minimum."""
    return blocks.groupBy("block").agg(
        F.count_if(F.col("label") == positive).alias("positives"),
        F.count_if(F.col("label") == negative).alias("negatives")) \
        .withColumn("complete", (F.col("positives") >= minimum) & (F.col("negatives") >= minimum))


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low + 1 < high:
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low


def template_swaps(texts: DataFrame, block: str = "block", key: str = "text_id", text: str = "text",
                   min_prefix: int = SWAP_PREFIX, share: float = SWAP_SHARE) -> DataFrame:
    """CQ2: texts that are the shorter side of a swap pair inside their block.

    A pair shares a prefix of at least ``min_prefix`` characters and ``share`` of the shorter
    text. In sorted order the longest common prefix with any text is the one with a neighbour,
    so the check needs a distributed sort and no pairs, however many texts share a beginning.
    -> (block, text_id, need, common): common >= need characters are shared with some text.
    """
    spark = texts.sparkSession
    block_type, key_type = dict(texts.dtypes)[block], dict(texts.dtypes)[key]
    sorted_texts = texts.filter(F.length(text) >= min_prefix).select(
        F.col(block).alias("b"), F.col(key).alias("k"), F.col(text).alias("t")) \
        .repartitionByRange("b", "t", "k").sortWithinPartitions("b", "t", "k")

    # Per row: the common prefix with the row before and after it inside its partition. The
    # first and the last row of a partition also report themselves as edges.
    def scan(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        columns = ["part", "edge", "b", "k", "t", "common"]
        held = None  # [block, key, text, common so far]
        first = True
        for batch in batches:
            out = []
            for b, k, t in zip(batch["b"], batch["k"], batch["t"]):
                common = 0
                if held is not None:
                    if held[0] == b:
                        common = _common(held[2], t)
                    out.append([part, None, held[0], held[1], held[2], max(held[3], common)])
                if first:
                    out.append([part, 0, b, k, t, 0])
                    first = False
                held = [b, k, t, common]
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held is not None:
            yield pd.DataFrame([[part, None, *held], [part, 1, held[0], held[1], held[2], 0]], columns=columns)

    found = cut_lineage(sorted_texts.mapInPandas(
        scan, f"part int, edge int, b {block_type}, k {key_type}, t string, common int"))
    # Two rows per partition: the last of one and the first of the next are neighbours.
    order = Window.orderBy("part", "edge")
    edges = found.filter("edge IS NOT NULL").select(
        "part", "edge", "b", "k", "t", F.lag(F.struct("b", "k", "t", "edge")).over(order).alias("p"))

    def cross(batches):
        for batch in batches:
            out = []
            for b, k, t, p in zip(batch["b"], batch["k"], batch["t"], batch["p"]):
                if p is not None and p["edge"] == 1 and p["b"] == b:
                    common = _common(p["t"], t)
                    out += [[b, k, t, common], [b, p["k"], p["t"], common]]
            yield pd.DataFrame(out, columns=["b", "k", "t", "common"])

    across = edges.filter("edge = 0 AND p IS NOT NULL").mapInPandas(
        cross, f"b {block_type}, k {key_type}, t string, common int")
    best = found.filter("edge IS NULL").select("b", "k", F.length("t").alias("n"), "common") \
        .unionByName(across.select("b", "k", F.length("t").alias("n"), "common")) \
        .groupBy("b", "k", "n").agg(F.max("common").alias("common"))
    need = F.greatest(F.lit(min_prefix), F.ceil(F.round(F.col("n") * share, 9))).cast("long")
    return best.withColumn("need", need).filter(F.col("common") >= F.col("need")) \
        .select(F.col("b").alias(block), F.col("k").alias(key), "need", F.col("common").cast("long").alias("common"))


def repeated_texts(texts: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """CQ3: trimmed texts that occur more than once inside a label; a hash stands for the text in the shuffle."""
    return texts.groupBy(label, F.sha2(F.trim(text), 256).alias("text_hash")) \
        .agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
