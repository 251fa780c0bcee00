"""Stored tables in hash partitions of their key: a batch reads and rewrites only the partitions that its keys fall into."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.session import cut_lineage
from corpusflow.sources.sinks import (CHUNK_UPDATE, SESSION_UPDATE, known_tenants, last_per_key, merged_columns, tenant_rows,
                                      tenant_update)

BUCKET = "_bucket"  # Spark's readers take a partition column of this name as any other


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(BUCKET)


def touched_buckets(rows: DataFrame) -> list[int]:
    """The buckets that stored rows fall into: at most as many numbers as the table has buckets reach the driver."""
    return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())


def overwrite_buckets(rows: DataFrame, path: str) -> None:
    """Replace the partitions that the rows belong to; all others keep their files."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


@dataclass(frozen=True)
class KeyedTable:
    """A Parquet table below ``path`` in folders ``_bucket=<n>``; the layout stands in ``path``/_layout.

    Keys are unique and a null is a key like any other. Choose ``buckets`` so that one of them holds some hundred MB: it is
    the least that a batch rewrites.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int
    schema: T.StructType

    def _read(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._read().drop(BUCKET)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Stored rows whose key is in ``wanted``; only the buckets of these keys are read."""
        wanted = cut_lineage(wanted.select(*self.keys).distinct().withColumn(BUCKET, bucket_of(list(self.keys), self.buckets)))
        condition = [F.col(f"s.{k}").eqNullSafe(F.col(f"w.{k}")) for k in self.keys]
        return self.part(touched_buckets(wanted)).alias("s").join(wanted.alias("w"), condition, "left_semi").drop(BUCKET)

    def part(self, buckets: list[int]) -> DataFrame:
        """The rows of some buckets with their bucket; the partition filter is in the scan."""
        return self._read().where(F.col(BUCKET).isin(buckets))

    def merge(self, incoming: DataFrame, update: dict[str, str], order: str | None = None) -> list[int]:
        """Upsert a batch by key (``update`` and ``order`` as for the joins in ``sinks``) and return the rewritten buckets.

        Of the rows of these buckets each moves once, to the task that writes its bucket, where old and new rows of a key
        meet. The same batch again changes nothing.
        """
        keys = list(self.keys)
        fresh = cut_lineage(last_per_key(incoming, keys, order).withColumn(BUCKET, bucket_of(keys, self.buckets)))
        touched = touched_buckets(fresh)
        if not touched:
            return []
        new_names = [c for c in fresh.columns if c not in (*keys, BUCKET)]
        old_names = [c for c in self.schema.names if c not in keys]
        key = F.struct(*keys).alias("_key")
        old = self.part(touched).select(key, BUCKET, F.struct(*old_names).alias("_o"))
        rows = old.unionByName(fresh.select(key, BUCKET, F.struct(*new_names).alias("_n")), allowMissingColumns=True)
        # one exchange: the grouping below and the written folders follow it
        both = rows.repartition(BUCKET).groupBy(BUCKET, "_key").agg(F.first("_o", True).alias("_o"), F.first("_n", True).alias("_n"))
        columns = merged_columns(self.schema.names, keys, update, set(new_names), F.col("_o").isNotNull(), F.col("_n").isNotNull(),
                                 *[lambda c, side=side: F.col(f"{'_key' if c in keys else side}.`{c}`") for side in ("_o", "_n")])
        typed = [c.cast(self.schema[name].dataType).alias(name) for c, name in zip(columns, self.schema.names)]
        overwrite_buckets(both.select(*typed, BUCKET), self.path)
        return touched

    def delete(self, gone: DataFrame) -> list[int]:
        """Remove the rows of the listed keys and return the rewritten buckets."""
        gone = cut_lineage(gone.select(*self.keys).distinct().withColumn(BUCKET, bucket_of(list(self.keys), self.buckets)))
        touched = touched_buckets(gone)
        condition = [F.col(f"s.{k}").eqNullSafe(F.col(f"g.{k}")) for k in self.keys]
        rest = cut_lineage(self.part(touched).alias("s").join(gone.alias("g"), condition, "left_anti").repartition(BUCKET))
        overwrite_buckets(rest, self.path)
        for bucket in set(touched).difference(touched_buckets(rest)):  # nothing is left to overwrite these with
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={bucket}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return touched


def create_table(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> KeyedTable:
    """Write rows with unique keys as a new table."""
    spark = rows.sparkSession
    layout = [(json.dumps(keys), buckets, rows.schema.json())]
    spark.createDataFrame(layout, "keys string, buckets int, schema string").coalesce(1).write.json(f"{path}/_layout")
    table = KeyedTable(spark, path, tuple(keys), buckets, rows.schema)
    overwrite_buckets(rows.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET), path)
    return table


def open_table(spark: SparkSession, path: str) -> KeyedTable:
    row = spark.read.schema("keys string, buckets int, schema string").json(f"{path}/_layout").first()
    return KeyedTable(spark, path, tuple(json.loads(row.keys)), row.buckets, T.StructType.fromJson(json.loads(row.schema)))


def merge_chunks(table: KeyedTable, incoming: DataFrame, order: str | None = None) -> list[int]:
    """SNK1 on a stored table keyed by chunk_id."""
    return table.merge(incoming, CHUNK_UPDATE, order)


def merge_tenants(table: KeyedTable, incoming: DataFrame, as_of: Column, strict_quirks: bool = True) -> list[int]:
    """SNK2 on a stored table keyed by tenant_id."""
    return table.merge(tenant_rows(incoming, as_of, strict_quirks), tenant_update(table.schema.names))


def merge_sessions(table: KeyedTable, incoming: DataFrame) -> list[int]:
    """SNK3 on a stored table keyed by session_id."""
    return table.merge(incoming, SESSION_UPDATE)


def load_stored_chunks(table: KeyedTable, incoming: DataFrame, tenants: DataFrame, order: str | None = None) -> DataFrame:
    """SNK13 on a stored table: merges the rows of known tenants and returns the others."""
    known, rejected = known_tenants(incoming, tenants)
    merge_chunks(table, known, order)
    return rejected
