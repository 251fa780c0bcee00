"""Theta joins without a cross join: slices of the small side, each of a bounded size, go to the tasks of the large side.

``prepare(small)`` is called once per task and slice and gives a function of the large side's rows, which returns matches
only (a top-k, or the hits of a substring search), never the pairs. ``merge`` reduces what a task has found so far. The large
side is read once per slice and is neither copied nor shuffled.

``streamed_product`` is the other way round, for two large sides: a block of the small side stays in a task, and the whole large
side, packed, passes by. What a row finds is known in one place, so nothing of it is emitted, sorted and merged again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.session import cut_lineage, shared_folder

#: Bounds of a slice of the small side, which is held by the driver and each worker.
SMALL_ROWS = 50_000
SMALL_BYTES = 128 * 1024 * 1024
#: Rows of the large side that meet a slice at once, and their most bytes; rows of several batches are put together.
BLOCK_ROWS, BLOCK_BYTES = 8_192, 32 * 1024 * 1024
#: Rows found that a task reduces at once, and those that it keeps for the next batch.
FOUND_ROWS, KEPT_ROWS = 200_000, 500_000

#: Rows and bytes of the large side that are packed together for ``streamed_product``.
PACK_ROWS, PACK_BYTES = 2_048, 4 * 1024 * 1024

Search = Callable[[pd.DataFrame], pd.DataFrame | Iterator[pd.DataFrame]]
Prepare = Callable[[pd.DataFrame], Search]
Merge = Callable[[pd.DataFrame], pd.DataFrame]


def _width(field: T.StructField):
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(field.dataType, T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(field.dataType, T.ArrayType):
        if isinstance(field.dataType.elementType, T.StringType):
            return F.coalesce(F.octet_length(F.array_join(column, " ")), F.lit(0))
        return F.coalesce(F.greatest(F.size(column), F.lit(0)) * 8, F.lit(0))
    return F.lit(8)


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, approximate bytes) by one aggregate job."""
    width = sum((_width(f) for f in df.schema.fields), F.lit(16)).cast("long")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def slices(small: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> Iterator[pd.DataFrame]:
    """The small side in measured slices, dealt by row number, so that repeats of a row do not fill one."""
    rows, size = measure(small)
    n = max(1, math.ceil(rows / max_rows), math.ceil(size / max_bytes))
    if n == 1:
        yield small.toPandas()
        return
    dealt = cut_lineage(small.withColumn("_slice", F.pmod(F.monotonically_increasing_id(), F.lit(n))))
    for number in range(n):
        yield dealt.where(F.col("_slice") == number).drop("_slice").toPandas()


def sliced_product(big: DataFrame, small: DataFrame, prepare: Prepare, schema: str, merge: Merge | None = None,
                   max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What the slices of ``small`` find in ``big``. Of several slices each is searched and stored before the next is sent."""
    spark = big.sparkSession
    held = slices(small, max_rows, max_bytes)
    found, sent = _searched(big, next(held), prepare, schema, merge, block_rows)
    folder = None
    for part in held:
        if folder is None:
            folder = shared_folder(spark, "slices")
            found.write.parquet(folder)
        sent.destroy()  # its hits are stored; neither the driver nor a worker keeps the slice
        later, sent = _searched(big, part, prepare, schema, merge, block_rows)
        later.write.mode("append").parquet(folder)
    if folder is None:
        return found
    sent.destroy()
    return spark.read.schema(found.schema).parquet(folder)


def _blocks(batches: Iterator[pd.DataFrame], block_rows: int) -> Iterator[pd.DataFrame]:
    """Rows of one or more batches together, at most ``block_rows`` and, by the width of their vectors, BLOCK_BYTES."""
    waiting: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        width = max([len(v) for c in batch.columns if (v := next(iter(batch[c].dropna()), None)) is not None and hasattr(v, "dtype") and v.ndim] or [1])
        most = max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, width))))
        at = 0
        while at < len(batch):
            part = batch.iloc[at:at + most - n] if n < most else batch.iloc[:0]
            waiting.append(part)
            n, at = n + len(part), at + len(part)
            if n >= most:
                yield pd.concat(waiting) if len(waiting) > 1 else waiting[0]
                waiting, n = [], 0
    if n:
        yield pd.concat(waiting) if len(waiting) > 1 else waiting[0]


def _searched(big: DataFrame, part: pd.DataFrame, prepare: Prepare, schema: str, merge: Merge | None, block_rows: int) -> tuple[DataFrame, Broadcast]:
    shared = big.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = prepare(shared.value)
        found: list[pd.DataFrame] = []
        waiting = kept = 0
        for block in _blocks(batches, block_rows):
            hits_of_block = search(block)
            for hits in (hits_of_block,) if isinstance(hits_of_block, pd.DataFrame) else hits_of_block:
                if merge is None:
                    yield hits
                    continue
                found.append(hits)
                waiting += len(hits)
                if waiting > max(FOUND_ROWS, kept):
                    found = [merge(pd.concat(found))]
                    waiting, kept = 0, len(found[0])
                    if kept > KEPT_ROWS:
                        yield found.pop()
                        kept = 0
        if found:
            yield merge(pd.concat(found))

    return big.mapInPandas(run, schema), shared


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, data): rows packed in their order; those of a column ``_block`` apart, with the block's number as a third column."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        if not batch.num_rows:
            continue
        of = [(None, batch)]
        if "_block" in batch.schema.names:
            block = batch.column("_block")
            plain = batch.drop_columns(["_block"])
            of = [(b, plain.filter(pc.equal(block, b))) for b in pc.unique(block)]
        for b, rows in of:
            step = max(1, min(PACK_ROWS, rows.num_rows * PACK_BYTES // max(1, rows.nbytes)))
            for at in range(0, rows.num_rows, step):
                pack = {"_number": [number], "_data": [_packed(rows.slice(at, step))]}
                yield pa.RecordBatch.from_pydict(pack if b is None else pack | {"_block": pa.array([b.as_py()], pa.int32())},
                                                 pa.schema([("_number", pa.int64()), ("_data", pa.binary()), *([] if b is None else [("_block", pa.int32())])]))
                number += 1


def streamed_product(big: DataFrame, small: DataFrame, blocks: int, prepare: Callable, schema: str, order: list | None = None) -> DataFrame:
    """What the rows of ``small`` find in ``big``, for a small side that is itself large and is stored (a checkpoint).

    The small side is dealt by row number into ``blocks``, each of a size that a task holds; the large side goes to each
    of them in packs, in the given order. ``prepare(list of tables of a block)`` gives an object whose ``add(table)`` takes a pack and
    whose ``finish()`` ends the block; both yield record batches of the schema.
    """
    dealt = small.withColumn("_block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"))
    asking = dealt.mapInArrow(_packs, "_number long, _data binary, _block int").withColumn("_kind", F.lit(0))
    if order:
        big = big.repartitionByRange(*order).sortWithinPartitions(*order)
    passing = big.mapInArrow(_packs, "_number long, _data binary") \
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_kind", F.lit(1))
    both = asking.unionByName(passing).repartitionById(blocks, "_block").sortWithinPartitions("_block", "_kind", "_number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, search = None, [], None
        for batch in batches:
            for block, kind, data in zip(batch.column("_block").to_pylist(), batch.column("_kind").to_pylist(), batch.column("_data")):
                if block != at:
                    if search is not None:
                        yield from search.finish()
                    at, waiting, search = block, [], None
                if kind == 0:
                    waiting.append(_unpacked(data.as_buffer()))
                elif waiting or search is not None:
                    if search is None:
                        search, waiting = prepare(waiting), []
                    yield from search.add(_unpacked(data.as_buffer()))
        if search is not None:
            yield from search.finish()

    return both.select("_block", "_kind", "_data").mapInArrow(run, schema)
