"""Crawling over stored pages: bounded search, sitemaps, plans, verdicts (CR)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.operators.extract import MIN_CONTENT, extract_chunks, is_resource
from corpusflow.session import cut_lineage
from corpusflow.sources.sinks import delete_keys, upsert_chunks

# Quality limits.
MIN_PAGES = 3
MIN_COVERAGE = 0.2
MIN_AVG_LENGTH = 500


def crawl_bfs(seeds: DataFrame, edges: DataFrame, fetched: DataFrame | None = None, max_depth: int | None = None,
              max_pages: int | None = None, ignore_case: bool = False) -> DataFrame:
    """CR1/CR2: breadth-first visit of all tenants at once.

    seeds(tenant_id, url[, position]), edges(tenant_id, url, position, link), fetched(tenant_id, url):
    pages that gave a chunk. Without limits the walk ends when no new page is left; ``max_depth`` ends it earlier, and
    with ``max_pages`` the visit of a tenant ends with its ``max_pages``-th page that gave a chunk.
    -> (tenant_id, url, depth, path). ``path`` holds the link positions from the seed; its order
    inside a depth is the discovery order, so no window over a tenant is needed while walking.
    Each level is stored once, which cuts lineage and makes the loop restartable.
    """
    def key(column: str) -> Column:
        return F.lower(column) if ignore_case else F.col(column)

    position = F.col("position").cast("int") if "position" in seeds.columns else F.lit(0)

    def first_of(rows: DataFrame, depth: int) -> DataFrame:
        best = rows.groupBy("tenant_id", "_key").agg(F.min_by(F.struct("url", "path"), F.col("path")).alias("_b"))
        return best.select("tenant_id", "_key", F.col("_b.url").alias("url"), F.lit(depth).alias("depth"),
                           F.col("_b.path").alias("path"))

    level = cut_lineage(first_of(seeds.select("tenant_id", "url", key("url").alias("_key"),
                                              F.array(position).alias("path")), 0))
    links = edges.select("tenant_id", F.col("url").alias("_from"), F.col("position").cast("int").alias("position"), "link")
    visited = level
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = level.join(links, (level.tenant_id == links.tenant_id) & (level.url == links._from)) \
            .select(level.tenant_id, F.col("link").alias("url"), key("link").alias("_key"),
                    F.concat("path", F.array("position")).alias("path"))
        step = step.join(visited.select("tenant_id", "_key"), ["tenant_id", "_key"], "left_anti")
        level = cut_lineage(first_of(step, depth))
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    visited = visited.drop("_key")
    if fetched is None or max_pages is None:
        return visited
    good = visited.join(fetched.select("tenant_id", "url").distinct(), ["tenant_id", "url"], "left_semi")
    ranked = good.withColumn("rn", F.row_number().over(
        Window.partitionBy("tenant_id").orderBy("depth", "path", "url")))
    return ranked.filter(F.col("rn") <= max_pages).drop("rn")


def new_urls(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """CR4: candidates(tenant_id, url) without a chunk yet; active chunks only, case ignored."""
    known = chunks.filter("is_active").select("tenant_id", F.lower("source_url").alias("_key"))
    return candidates.withColumn("_key", F.lower("url")).join(known, ["tenant_id", "_key"], "left_anti").drop("_key")


def crawl_sitemap(urls: DataFrame, pages: DataFrame, existing: DataFrame | None = None, **options) -> DataFrame:
    """CR3: sitemap URLs, distinct, no resources, minus known ones -> chunks of the stored pages."""
    wanted = urls.select("tenant_id", "url").distinct().filter(~is_resource(F.col("url")))
    if existing is not None:
        wanted = new_urls(wanted, existing)
    return extract_chunks(wanted.join(pages.select("url", "html"), "url"), **options)


def crawl_plan(tenants: DataFrame, sitemap_chunks: DataFrame, incremental: Column) -> DataFrame:
    """CR5: (tenant_id, mode): sitemap if it gave chunks, nothing when incremental, else links."""
    counts = sitemap_chunks.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("_n"))
    return tenants.join(counts, "tenant_id", "left").select(
        "tenant_id", F.when(F.coalesce("_n", F.lit(0)) > 0, "sitemap").when(incremental, "nothing")
        .otherwise("links").alias("mode"))


def run_plan(plan: DataFrame, sitemap_chunks: DataFrame, link_chunks: DataFrame) -> DataFrame:
    """CR5: chunks of both ways, each tenant from the way its plan names."""
    return sitemap_chunks.join(plan.filter("mode = 'sitemap'"), "tenant_id", "left_semi").unionByName(
        link_chunks.join(plan.filter("mode = 'links'"), "tenant_id", "left_semi"))


def recrawl(existing: DataFrame, fresh: DataFrame, tenants: DataFrame, incremental: bool) -> DataFrame:
    """CR6: full mode replaces the tenants' chunks, incremental mode adds to them."""
    kept = existing if incremental else delete_keys(existing, tenants.select("tenant_id"), "tenant_id")
    return upsert_chunks(kept, fresh)


def quality_verdict(tenants: DataFrame, chunks: DataFrame, expected: DataFrame, incremental: bool = False) -> DataFrame:
    """CR7: (tenant_id, pages, avg_length, expected, reason, retry); ordered rules, null reason = fine."""
    stats = chunks.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("pages"),
                                            F.avg(F.coalesce(F.length("content"), F.lit(0))).alias("avg_length"))
    return verdict_of(tenants.select("tenant_id").join(stats, "tenant_id", "left")
                      .join(expected.select("tenant_id", "expected"), "tenant_id", "left"), incremental)


def verdict_of(stats: DataFrame, incremental: bool = False) -> DataFrame:
    pages, expected = F.coalesce("pages", F.lit(0).cast("long")), F.coalesce("expected", F.lit(0).cast("long"))
    average = F.coalesce("avg_length", F.lit(0.0))
    reason = F.when(pages < MIN_PAGES, "few_pages") \
        .when((expected > 0) & (pages < expected * MIN_COVERAGE), "low_coverage") \
        .when((pages > 0) & (average < MIN_AVG_LENGTH), "short_content")
    return stats.select("tenant_id", pages.alias("pages"), average.alias("avg_length"), expected.alias("expected"),
                        reason.alias("reason"), (reason.isNotNull() & F.lit(not incremental)).alias("retry"))


def retry_rendered(pages: DataFrame, chunks: DataFrame, verdicts: DataFrame, **options) -> DataFrame:
    """CR8: tenants with a retry verdict are extracted again with the rendered profile; their rows are replaced.

    pages(tenant_id, url, html).
    """
    again = verdicts.filter("retry").select("tenant_id")
    second = extract_chunks(pages.join(again, "tenant_id", "left_semi"), profile="rendered", **options)
    return chunks.join(again, "tenant_id", "left_anti").unionByName(second)


def retry_single(parsed_plain: DataFrame, pages: DataFrame, min_len: int = MIN_CONTENT, **options) -> DataFrame:
    """CR8, single pages: those below the minimum length go through the rendered profile."""
    short = parsed_plain.filter(F.length("content") < min_len).select("url")
    return extract_chunks(pages.join(short, "url", "left_semi"), profile="rendered", **options)


def job_progress(results: DataFrame) -> DataFrame:
    """CR9: per job: tenants, successes, failures, pages and status.

    results(job_id, tenant_id, pages, error); null pages = not processed yet.
    """
    done = F.col("pages").isNotNull() | F.col("error").isNotNull()
    return results.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(done).alias("processed"),
        F.count_if(F.col("pages").isNotNull() & F.col("error").isNull()).alias("succeeded"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("pages"))), F.lit(0).cast("long")).alias("pages")) \
        .withColumn("status", F.when(F.col("processed") < F.col("total"), "running").otherwise("completed"))
