"""Intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.session import shared_folder, ship_package

#: Bytes of rows that go to a Python worker at once: texts may be long, and an executor holds a batch for each core twice.
BATCH_BYTES = "8m"


def ready(spark: SparkSession) -> None:
    """Ship the package and bound the batches for workers; a bound that the session sets below it stays."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > 8 << 20:
        spark.conf.set(key, BATCH_BYTES)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet below ``spark.checkpoint.dir`` and read back: cuts lineage, survives executors."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that no later step reads."""
    for file in df.inputFiles()[:1]:
        drop_folder(df.sparkSession, file.rsplit("/", 1)[0])


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
