"""Labelled-corpus reader (SRC6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.text import strip


def parse_labeled_lines(lines: DataFrame, header: str = "label") -> DataFrame:
    """lines(value) -> (value, label, text, ok) without blank, comment and header lines."""
    line = strip(F.col("value"))
    rows = lines.select(line.alias("value")) \
        .filter((F.col("value") != "") & ~F.col("value").startswith("#")
                & (F.lower("value") != f"{header.lower()}\ttext"))
    parts = F.split("value", "\t", 2)
    return rows.select("value", F.trim(parts[0]).alias("label"), strip(F.get(parts, F.lit(1))).alias("text"),
                       ((F.size(parts) == 2) & (parts[0] != "") & (F.coalesce(F.get(parts, F.lit(1)), F.lit("")) != "")).alias("ok"))


def read_labeled_tsv(spark: SparkSession, path: str, strict: bool = False, header: str = "label",
                     known: list[str] | None = None, require_all: bool = False) -> DataFrame:
    """SRC6: (label, text). ``strict`` raises on a broken line or an unknown label; else such lines are skipped.

    ``require_all`` raises unless every known label occurs.
    """
    parsed = parse_labeled_lines(spark.read.text(path), header)
    if strict:
        bad = parsed.filter(~F.col("ok") | (~F.col("label").isin(*known) if known else F.lit(False)))
        first = bad.select("value").head(1)
        if first:
            raise ValueError(f"invalid corpus line: {first[0]['value']}")
    data = parsed.filter("ok").select("label", "text")
    if require_all and known:
        found = {r["label"] for r in data.filter(F.col("label").isin(*known)).select("label").distinct().collect()}
        if not found:
            raise ValueError("the corpus holds no sentences")
        missing = [c for c in known if c not in found]
        if missing:
            raise ValueError(f"labels without sentences: {', '.join(missing)}")
    return data
