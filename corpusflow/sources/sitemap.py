"""Sitemap documents to page URLs (SRC8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import strip
from corpusflow.session import cut_lineage
from corpusflow.sources.tables import host_of


def _decode(text):
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def sitemap_entries(docs: DataFrame) -> DataFrame:
    """(sitemap_url, is_index, position, loc): loc values of url or sitemap elements; broken documents
    (no closing root) yield no rows, so one bad document cannot stop the job."""
    xml = F.col("xml")
    whole = xml.rlike(r"(?is)</\s*(?:\w+:)?(?:urlset|sitemapindex)\s*>\s*$")
    index = xml.rlike(r"(?i)<(?:\w+:)?sitemap[\s>]")

    def locs(element: str):
        return F.regexp_extract_all(xml, F.lit(
            rf"(?is)<(?:\w+:)?{element}(?:\s[^>]*)?>(?:(?!</(?:\w+:)?{element}>).)*?<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), F.lit(1))

    found = F.when(index, locs("sitemap")).otherwise(locs("url"))
    return docs.filter(whole).select("sitemap_url", index.alias("is_index"), F.posexplode(found).alias("position", "loc")) \
        .withColumn("loc", _decode(strip(F.col("loc")))).filter("loc <> ''")


def sitemap_urls(docs: DataFrame, candidates: DataFrame, allowed: DataFrame) -> DataFrame:
    """SRC8: (tenant_id, url) of the first candidate with any URL; index files are followed.

    docs(sitemap_url, xml); candidates(tenant_id, priority, sitemap_url); allowed(tenant_id, host).
    The loop does one join per nesting level and ends when no index is left that was not followed before.
    """
    entries = cut_lineage(sitemap_entries(docs))
    frontier = candidates.select("tenant_id", "priority", "sitemap_url")
    seen = frontier
    found = None
    while True:
        rows = frontier.join(entries, "sitemap_url")
        urls = rows.filter("NOT is_index").select("tenant_id", "priority", F.col("loc").alias("url"))
        found = urls if found is None else found.unionByName(urls)
        frontier = cut_lineage(
            rows.filter("is_index").select("tenant_id", "priority", F.col("loc").alias("sitemap_url")).distinct()
            .join(seen, ["tenant_id", "priority", "sitemap_url"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    kept = found.withColumn("host", host_of(F.col("url"))) \
        .join(allowed.select("tenant_id", F.lower("host").alias("host")), ["tenant_id", "host"], "left_semi")
    first = kept.groupBy("tenant_id").agg(F.min("priority").alias("priority"))
    return kept.join(first, ["tenant_id", "priority"], "left_semi").select("tenant_id", "url").distinct()
