"""Crawl and index all sites together: sitemap or links, chunks, verdicts, second profile, vectors (CR5-CR8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators import crawl as cr
from corpusflow.operators.extract import MIN_CONTENT, chunks_of, embed_texts, links_of, parse_pages
from corpusflow.session import cut_lineage
from corpusflow.sources.sitemap import sitemap_urls
from corpusflow.sources.tables import host_of, sitemap_candidates


def _crawl(tenants: DataFrame, hosts: DataFrame, mapped: DataFrame, existing: DataFrame, parsed: DataFrame, incremental: bool,
           max_depth: int | None, max_pages: int | None, crawled_at: Column | None) -> DataFrame:
    """Chunks of each tenant from its sitemap, or else from its links; ``parsed`` is one profile's view of the pages."""
    wanted = cr.new_urls(mapped, existing) if incremental else mapped
    by_map = chunks_of(wanted.join(parsed, "url"), F.col("tenant_id"), crawled_at=crawled_at)
    plan = cr.crawl_plan(tenants, by_map, F.lit(incremental))
    # a tenant owns the pages of all its hosts, and follows their links to any of them
    owned = parsed.withColumn("host", host_of(F.col("url"))).join(hosts, "host")
    edges = links_of(owned, keep=["tenant_id"], same_host=False).withColumn("host", host_of(F.col("link"))) \
        .join(hosts, ["tenant_id", "host"], "left_semi").select("tenant_id", "url", "position", "link")
    seeds = tenants.join(plan.filter("mode = 'links'"), "tenant_id", "left_semi").select("tenant_id", F.col("base_url").alias("url"))
    fit = owned.filter(F.length("content") >= MIN_CONTENT).select("tenant_id", "url")
    walked = cr.crawl_bfs(seeds, edges, fit, max_depth, max_pages)
    by_links = chunks_of(walked.select("tenant_id", "url").join(parsed, "url"), F.col("tenant_id"), crawled_at=crawled_at)
    return cr.run_plan(plan, by_map, by_links)


def crawl_sites(tenants: DataFrame, pages: DataFrame, sitemaps: DataFrame, existing: DataFrame, incremental: bool = False,
                max_depth: int | None = None, max_pages: int | None = None, embed=None,
                crawled_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(next chunk table, verdicts). tenants(tenant_id, base_url, allowed_domains), pages(url, html),
    sitemaps(sitemap_url, xml), existing chunks.

    Every page is parsed once; both crawl ways and the links read the stored result. Tenants whose verdict asks for it
    are crawled again as a whole, sitemap first and then links, over all their pages read by the rendered profile.
    """
    hosts = tenants.select("tenant_id", F.explode("allowed_domains").alias("host")).select("tenant_id", F.lower("host").alias("host")).distinct()
    candidates = sitemap_candidates(tenants.select("tenant_id", "base_url")).select("tenant_id", "priority", "sitemap_url")
    mapped = cut_lineage(sitemap_urls(sitemaps, candidates, hosts))
    plain = cut_lineage(parse_pages(pages))
    fresh = cut_lineage(_crawl(tenants, hosts, mapped, existing, plain, incremental, max_depth, max_pages, crawled_at))
    expected = mapped.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("expected"))
    verdicts = cr.quality_verdict(tenants, fresh, expected, incremental)
    if not incremental:
        again = cut_lineage(verdicts.filter("retry").select("tenant_id"))
        theirs = hosts.join(again, "tenant_id", "left_semi")
        rendered = cut_lineage(parse_pages(
            pages.withColumn("host", host_of(F.col("url"))).join(theirs.select("host"), "host", "left_semi"), "rendered"))
        second = _crawl(tenants.join(again, "tenant_id", "left_semi"), theirs, mapped.join(again, "tenant_id", "left_semi"), existing,
                        rendered, incremental, max_depth, max_pages, crawled_at)
        fresh = fresh.join(again, "tenant_id", "left_anti").unionByName(second)
    vectors = embed_texts(fresh, "content", "embedding", embed)
    return cr.recrawl(existing, vectors, tenants, incremental), verdicts
