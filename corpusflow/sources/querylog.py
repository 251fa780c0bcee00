"""Query-log text files to rows (SRC7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Record separator, field names and verdict marks of the log format.
SEPARATOR = "═" * 70
FIELDS = {"query": "Query", "language": "Language", "prompt_key": "Prompt"}
DECISION = "Ergebnis"
VERDICT_YES, VERDICT_NO = "PASST:JA", "PASST:NEIN"


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: (ts, category, query, language, prompt_key, decision, verdicts array<struct<name, matches>>).

    Records are split by the reader at the separator line, so one day file may be read by many tasks.
    """
    raw = spark.read.option("lineSep", SEPARATOR).text(path)
    body = F.col("value")
    head = F.regexp_extract(body, r"\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\]  (.*)", 1)

    def field(name: str):
        return F.trim(F.regexp_extract(body, rf"(?m)^  {name}\s*: ([^\n]*)", 1))

    lines = F.regexp_extract_all(body, F.lit(rf"(?m)^  \S+    : ([^\n]*?  →  (?:{VERDICT_YES}|{VERDICT_NO}))"), F.lit(1))
    verdicts = F.transform(lines, lambda v: F.struct(
        F.element_at(F.split(v, "  →  "), 1).alias("name"), v.endswith(VERDICT_YES).alias("matches")))
    rows = raw.filter(head != "").select(
        F.to_timestamp(head).alias("ts"), F.trim(F.regexp_extract(body, r"\]  ([^\n]*)", 1)).alias("category"),
        *[field(mark).alias(name) for name, mark in FIELDS.items()],
        F.split(field(DECISION), "  →  ")[0].alias("decision"), verdicts.alias("verdicts"))
    return rows.withColumn("decision", F.when(F.col("decision") != "", F.col("decision")))


def format_records(log: DataFrame) -> DataFrame:
    """The text form of checked queries, one ``value`` per record (without the separator)."""
    ok = F.col("category") == "ANFRAGE OK"
    return log.select(F.concat(
        F.lit("\n["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("]  "), "category", F.lit("\n  Query    : "), "query",
        F.lit("\n  Language : "), "language", F.lit("\n  Prompt   : "), "prompt_key", F.lit(f"\n\n  {DECISION} : "),
        F.when(ok, "JA").otherwise("NEIN"), F.lit("\n\n")).alias("value"))
