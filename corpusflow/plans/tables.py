"""The test tables seen as tenants, chunks, queries and turns, in Spark and in SQL.

Each helper has a SQL twin of the same name in ``CTE``; a twin may be used in a WITH list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Tables whose rows cost much CPU each; a one-file copy is spread over the cores after the scan.
HEAVY = {"documents", "pages", "embeddings", "conversations"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in HEAVY and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def vector_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.concat(F.lit("t"), F.col("label")).alias("tenant_id"),
        F.concat(F.lit("https://t"), F.col("label"), F.lit(".example.com/P"), F.floor(F.col("vec_id") / 3))
        .alias("source_url"),
        F.concat(F.lit("Topic "), F.col("vec_id") % 5).alias("title"),
        (F.col("vec_id") % 13 != 5).alias("is_active"), "embedding")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.concat(F.lit("t"), F.col("label")).alias("tenant_id"), "embedding")


def vector_tenants(spark: SparkSession, sf: str) -> DataFrame:
    """One tenant per label; region and location come from the nation of the same number."""
    labels = table(spark, sf, "embeddings").select("label").distinct()
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("label"), "n_name", "n_regionkey")
    region = table(spark, sf, "region")
    return labels.join(nation, "label").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("t"), F.col("label")).alias("tenant_id"),
        F.concat(F.lit("Hotel "), F.col("n_name")).alias("name"),
        F.concat(F.lit("t"), F.col("label"), F.lit(".example.com")).alias("domain"),
        F.col("n_name").alias("location"), F.col("r_name").alias("region"),
        F.lit("Country").alias("country"), (F.col("label") != 7).alias("is_active"),
        (F.lit(46.0) + F.col("label") * 13 % 300 / 100.0).alias("latitude"),
        (F.lit(10.0) + F.col("label") * 37 % 400 / 100.0).alias("longitude"))


def supplier_tenants(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as tenants with derived domain, region, coordinates and JSON lists."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier") \
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey")) \
        .join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("t"), key).alias("tenant_id"), F.col("s_name").alias("name"),
        F.concat(F.lit("s"), key, F.lit(".example.com")).alias("domain"),
        F.when(key % 6 != 0, F.col("r_name")).alias("region"), F.col("n_name").alias("location"),
        F.lit("Country").alias("country"), (key % 7 != 3).alias("is_active"),
        F.when(key % 9 != 4, F.lit(46.0) + key * 13 % 300 / 100.0).alias("latitude"),
        F.when(key % 9 != 4, F.lit(10.0) + key * 37 % 400 / 100.0).alias("longitude"),
        (key % 4 == 1).alias("has_lift"), F.col("s_acctbal").alias("balance"),
        F.concat(F.lit('["s'), key, F.lit('.example.com","www.S'), key, F.lit('.example.com"]')).alias("domains_json"))


CTE = {
    "chunks": """chunks AS (SELECT vec_id AS chunk_id, 't' || label AS tenant_id,
        'https://t' || label || '.example.com/P' || CAST(floor(vec_id / 3.0) AS BIGINT) AS source_url,
        'Topic ' || (vec_id % 5) AS title, vec_id % 13 <> 5 AS is_active, embedding FROM embeddings)""",
    "queries": "queries AS (SELECT vec_id AS query_id, 't' || label AS tenant_id, embedding FROM embeddings)",
    "vtenants": """vtenants AS (SELECT 't' || label AS tenant_id,
        'Hotel ' || n_name AS name, 't' || label || '.example.com' AS domain,
        n_name AS location, r_name AS region,
        'Country' AS country, label <> 7 AS is_active, 46.0::DOUBLE + label * 13 % 300 / 100.0::DOUBLE AS latitude,
        10.0::DOUBLE + label * 37 % 400 / 100.0::DOUBLE AS longitude
        FROM (SELECT DISTINCT label FROM embeddings) JOIN nation ON n_nationkey = label
        JOIN region ON r_regionkey = n_regionkey)""",
    "tenants": """tenants AS (SELECT 't' || s_suppkey AS tenant_id, s_name AS name,
        's' || s_suppkey || '.example.com' AS domain, CASE WHEN s_suppkey % 6 <> 0 THEN r_name END AS region,
        n_name AS location, 'Country' AS country, s_suppkey % 7 <> 3 AS is_active,
        CASE WHEN s_suppkey % 9 <> 4 THEN 46.0::DOUBLE + s_suppkey * 13 % 300 / 100.0::DOUBLE END AS latitude,
        CASE WHEN s_suppkey % 9 <> 4 THEN 10.0::DOUBLE + s_suppkey * 37 % 400 / 100.0::DOUBLE END AS longitude,
        s_suppkey % 4 = 1 AS has_lift, s_acctbal AS balance, s_suppkey AS nr,
        '["s' || s_suppkey || '.example.com","www.S' || s_suppkey || '.example.com"]' AS domains_json
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names)


# Phrases that are mixed into the conversation turns, so that tags and intents occur.
PHRASES = [
    "Welche Hotels kennst du in Tirol?", "Something in Carinthia please", "Wieviele Zimmer gibt es dort?",
    "so nah an Salzburg-Stadt wie möglich", "nahe Salzburg-Stadt mit Skilift vor dem Hotel",
    "Which hotel is closest to Zell am See?", "more sources please", "Which hotels do you know?",
    "Ich suche ein Hotel mit Sauna in Tirol", "Hotel near Kaprun or near a ski area",
    "nähe zu Innsbruck und Seefeld", "near a skigebiet, close to Mondsee", "Hotel nation_4 bitte", "ok",
    "English please", "Hotels in Salzburg", "Was kostet Hotel NATION_1 oder NATION_12?", "NATION_2 und NATION_3",
    "close to Wien with sauna", "unweit Innsbruck, pool und Skigebiet",
]


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns; every text ends in a phrase, every second one is the phrase alone."""
    pick = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), ((F.col("conv_id") * 3 + F.col("turn") * 7) % len(PHRASES) + 1).cast("int"))
    alone = (F.col("conv_id") + F.col("turn")) % 2 == 0
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("s"), "conv_id").alias("session_id"), "turn", "role",
        F.when(alone, pick).otherwise(F.concat("text", F.lit(" "), pick)).alias("text"))


_LIST = ", ".join("'" + p + "'" for p in PHRASES)
CTE["turns"] = f"""turns AS (SELECT 's' || conv_id AS session_id, turn, role, CASE WHEN (conv_id + turn) % 2 = 0 THEN p ELSE text || ' ' || p END AS text
    FROM (SELECT *, [{_LIST}][(conv_id * 3 + turn * 7) % {len(PHRASES)} + 1] AS p FROM conversations))"""
