"""Scans, lookups and JSON columns (SRC1-SRC5, SRC9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE_SCHEMA = (
    "array<struct<message_id:string,session_id:string,role:string,content:string,timestamp:timestamp,"
    "is_voice_input:boolean,language:string,retrieval_chunk_ids:array<string>,confidence_score:double>>")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", order_by: list[str] | None = None,
               **options) -> DataFrame:
    """SRC1: full scan in any Spark format (parquet, orc, json, csv, jdbc), optionally ordered."""
    df = spark.read.format(fmt).options(**options).load(path)
    return df.orderBy(*order_by) if order_by else df


def lookup(df: DataFrame, keys: DataFrame, on: str, active_only: bool = False) -> DataFrame:
    """SRC2: rows whose key is listed; blank keys are dropped, repeated ones count once.

    Catalyst broadcasts the keys if they are small; a semi join needs no distinct.
    """
    if active_only:
        df = df.filter("is_active")
    return df.join(keys.filter(F.trim(on) != "").select(on), on, "left_semi")


def match_domain(tenants: DataFrame, hosts: DataFrame) -> DataFrame:
    """SRC3: (host, tenant_id) where the domain or any allowed domain equals the host without case."""
    names = tenants.select("tenant_id", F.explode(
        F.array_distinct(F.transform(F.concat(F.array("domain"), F.coalesce("allowed_domains", F.array())), lambda d: F.lower(d))))
        .alias("_host"))
    return hosts.select("host", F.lower("host").alias("_host")).join(names, "_host").select("host", "tenant_id")


def parse_json_list(column: str | Column) -> Column:
    """SRC4: JSON text to array of string; null or broken text gives an empty list."""
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))


def explode_sessions(sessions: DataFrame) -> DataFrame:
    """SRC5: one row per turn out of the JSON list of messages."""
    parsed = sessions.withColumn("_messages", F.from_json("messages", MESSAGE_SCHEMA))
    return parsed.select(*[c for c in sessions.columns if c != "messages"],
                         F.posexplode("_messages").alias("turn", "_m")) \
        .select(*[c for c in sessions.columns if c != "messages"], "turn",
                F.col("_m.message_id").alias("message_id"), F.col("_m.role").alias("role"),
                F.col("_m.content").alias("content"), F.col("_m.timestamp").alias("ts"),
                F.col("_m.is_voice_input").alias("is_voice_input"), F.col("_m.language").alias("language"),
                F.col("_m.retrieval_chunk_ids").alias("retrieval_chunk_ids"),
                F.col("_m.confidence_score").alias("confidence_score"))


def tenant_sessions(sessions: DataFrame) -> DataFrame:
    """SRC5: sessions of each tenant, newest first."""
    return sessions.orderBy("tenant_id", F.desc("updated_at"), "session_id")


def host_of(url: Column) -> Column:
    """Lower-cased host without port; null for what is no absolute URL."""
    host = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.lower(host))


def sitemap_candidates(df: DataFrame, base_url: str = "base_url") -> DataFrame:
    """SRC9: (…, priority, sitemap_url): the base and host variants, distinct, in order."""
    base = F.regexp_replace(base_url, "/+$", "")
    host = F.concat(F.lit("https://"), host_of(F.col(base_url)))
    urls = F.array_distinct(F.array(
        F.concat(base, F.lit("/sitemap.xml")), F.concat(base, F.lit("/sitemap_index.xml")),
        F.concat(host, F.lit("/sitemap.xml")), F.concat(host, F.lit("/sitemap_index.xml"))))
    return df.select("*", F.posexplode(urls).alias("priority", "sitemap_url"))
