"""Reports over tenants, chunks, sitemaps, feedback, logs and traces (BI)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.scan import running_sum
from corpusflow.functions.text import is_blank
from corpusflow.operators.retrieve import chunk_counts

# Health limits.
PROBLEM_CHUNKS = 10
GOOD_CHUNKS = 30
FEEDBACK_FIELDS = ["tenant_id", "name", "keyword", "text"]


def content_stats(tenants: DataFrame, chunks: DataFrame) -> DataFrame:
    """BI1: every tenant with its active chunk count and has_content."""
    return tenants.join(chunk_counts(chunks), "tenant_id", "left") \
        .withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("long"))) \
        .withColumn("has_content", F.col("chunks") > 0)


def content_totals(stats: DataFrame) -> DataFrame:
    """BI1: totals with, without and over all, by one rollup."""
    return stats.rollup("has_content").agg(F.count(F.lit(1)).alias("tenants"), F.sum("chunks").alias("chunks")) \
        .withColumn("has_content", F.coalesce(F.col("has_content").cast("string"), F.lit("total")))


def is_index(xml: Column) -> Column:
    return F.contains(F.lower(xml), F.lit("<sitemapindex"))


def loc_values(xml: Column) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?i)<loc>(.*?)</loc>"), F.lit(1)), lambda u: F.trim(u))


def url_entries(xml: Column) -> Column:
    """Number of url elements that start with a loc."""
    return F.size(F.regexp_extract_all(xml, F.lit(r"(?i)<url>\s*<loc>"), F.lit(0)))


def sitemap_counts(tenants: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """BI4: (tenant_id, sitemap_urls, sitemap_status); an index is summed over its children.

    sitemaps(sitemap_url, xml[, status]) holds what was fetched; a tenant's own document is
    https://<domain>/sitemap.xml.
    """
    own = tenants.select("tenant_id", F.concat(F.lit("https://"), "domain", F.lit("/sitemap.xml")).alias("sitemap_url"))
    status = F.col("status") if "status" in sitemaps.columns else F.lit(None).cast("string")
    docs = sitemaps.select("sitemap_url", "xml", status.alias("_status"))
    direct = own.join(docs, "sitemap_url", "left")
    index = direct.filter(is_index(F.col("xml")))
    children = index.select("tenant_id", F.explode(loc_values(F.col("xml"))).alias("sitemap_url")) \
        .join(docs.select("sitemap_url", url_entries(F.col("xml")).alias("n")), "sitemap_url") \
        .groupBy("tenant_id").agg(F.sum("n").alias("_child_urls"))
    joined = direct.join(children, "tenant_id", "left")
    through = F.coalesce(is_index(F.col("xml")), F.lit(False))
    urls = F.when(through, F.coalesce("_child_urls", F.lit(0).cast("long"))) \
        .when(F.col("xml").isNotNull(), url_entries(F.col("xml")).cast("long")).otherwise(F.lit(0).cast("long"))
    state = F.when(F.col("_status") == "error", "error").when(F.col("xml").isNull(), "not_found") \
        .when(through & (F.coalesce("_child_urls", F.lit(0)) > 0), "found_index").when(through, "found_empty") \
        .otherwise("found")
    return joined.select("tenant_id", urls.alias("sitemap_urls"), state.alias("sitemap_status"))


def crawl_health(stats: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """BI2: health class by chunk count, coverage in % with one decimal or n/a."""
    status = F.when(F.col("chunks") == 0, "not_crawled").when(F.col("chunks") < PROBLEM_CHUNKS, "problematic") \
        .when(F.col("chunks") < GOOD_CHUNKS, "warning").otherwise("good")
    urls = F.coalesce("sitemap_urls", F.lit(0).cast("long"))
    coverage = F.when(urls > 0, F.concat(F.format_string("%.1f", F.col("chunks") / urls * 100), F.lit("%"))).otherwise("n/a")
    return stats.join(sitemaps, "tenant_id", "left").withColumn("sitemap_urls", urls) \
        .withColumn("sitemap_status", F.coalesce("sitemap_status", F.lit("unknown"))) \
        .withColumn("status", status).withColumn("coverage", coverage)


def render_signals(html: Column) -> Column:
    """EX11: array of frameworks and lazy-loading marks mentioned in the page (plain substrings)."""
    lower = F.lower(html)

    def flag(name: str, *needles: str) -> Column:
        test = F.lit(False)
        for needle in needles:
            test = test | F.contains(lower, F.lit(needle))
        return F.when(test, F.lit(name))

    return F.filter(F.array(
        flag("React", "react"), flag("Vue", "vue"), flag("Angular", "angular"), flag("Next.js", "next.js"),
        flag("lazy", 'loading="lazy"', "lazyload")), lambda x: x.isNotNull())


def diagnose(health: DataFrame, home_pages: DataFrame) -> DataFrame:
    """BI3: arrays of finding and advice codes per tenant. home_pages(tenant_id, html)."""
    joined = health.join(home_pages.select("tenant_id", "html"), "tenant_id", "left") \
        .withColumn("_signals", render_signals(F.col("html")))
    has_map = F.col("sitemap_status").isin("found", "found_index", "found_empty")
    low = has_map & (F.col("sitemap_urls") > 0) & (F.col("sitemap_urls") > F.col("chunks") * 2)
    frameworks = F.filter("_signals", lambda s: s != "lazy")
    js = F.coalesce(F.size(frameworks) > 0, F.lit(False))
    lazy = F.coalesce(F.array_contains("_signals", "lazy"), F.lit(False))
    down = F.col("html").isNull()

    def keep(*items: Column) -> Column:
        return F.filter(F.array(*items), lambda x: x.isNotNull())

    findings = keep(
        F.concat(F.lit("chunks:"), F.col("chunks").cast("string")),
        F.when(has_map, F.concat(F.col("sitemap_status"), F.lit(":"), F.col("sitemap_urls").cast("string"))),
        F.when(low, "low_coverage"), F.when(F.col("sitemap_status") == "not_found", "no_sitemap"),
        F.when(F.col("sitemap_status") == "error", "sitemap_error"),
        F.when(js, F.concat(F.lit("js:"), F.array_join(frameworks, ","))), F.when(lazy, "lazy_loading"),
        F.when(down, "unreachable").otherwise(F.concat(F.lit("reachable:"), F.length("html").cast("string"))))
    advice = keep(
        F.when(low, "try_rendered_profile"), F.when(F.col("sitemap_status") == "not_found", "crawl_links_deeper"),
        F.when(js, "use_rendered_profile"), F.when(lazy, "use_rendered_profile_lazy"),
        F.when(down, "check_domain"), F.when(F.col("chunks") < PROBLEM_CHUNKS, "raise_page_limit"))
    return joined.select("tenant_id", "chunks", "sitemap_urls", has_map.alias("has_sitemap"),
                         findings.alias("findings"), advice.alias("advice"))


def feedback_report(feedback: DataFrame, tenants: DataFrame) -> DataFrame:
    """BI5: feedback with the tenant's name, newest first."""
    return feedback.join(tenants.select("tenant_id", F.col("name").alias("tenant_name")), "tenant_id", "left") \
        .orderBy(F.desc("created_at"), F.desc("id"))


def validate_feedback(feedback: DataFrame, tenants: DataFrame) -> DataFrame:
    """BI6: add ``error``, the first failing rule, null for accepted rows."""
    known = tenants.select("tenant_id", F.lit(True).alias("_known"))
    joined = feedback.join(known, "tenant_id", "left")
    error = F.when(is_blank(F.col("tenant_id")), "tenant_id")
    for name in FEEDBACK_FIELDS[1:]:
        error = error.when(is_blank(F.col(name)), name)
    return joined.withColumn("error", error.when(F.col("_known").isNull(), "unknown_tenant")).drop("_known")


def query_log_report(log: DataFrame) -> DataFrame:
    """BI7: checked queries by day, category and language."""
    return log.groupBy(F.to_date("ts").alias("day"), "category", "language").agg(F.count(F.lit(1)).alias("n"))


def step_durations(steps: DataFrame) -> DataFrame:
    """BI8: pair the n-th start with the n-th end of an agent in a run.

    steps(run_id, agent, kind, phase, elapsed_ms, duration_ms, status); an end without a
    duration takes the difference of the elapsed times; a start without an end stays running.
    Steps of one time count in the order of a hash of the row; equal rows are alike in any order.
    """
    tied = steps.withColumn("_one", F.lit(1)).withColumn("_tie", F.xxhash64("kind", "duration_ms", "status"))
    numbered = running_sum(tied, ["run_id", "agent", "phase"], ["elapsed_ms", "_tie"], "_one", "occurrence").drop("_one", "_tie")
    start, end = F.col("phase") == "start", F.col("phase") == "end"
    paired = numbered.groupBy("run_id", "agent", "occurrence").agg(
        F.coalesce(F.max(F.when(end, F.col("kind"))), F.max("kind")).alias("kind"),
        F.max(F.when(start, F.col("elapsed_ms"))).alias("started_ms"),
        F.max(F.when(end, F.col("elapsed_ms"))).alias("ended_ms"),
        F.max(F.when(end, F.col("duration_ms"))).alias("_duration"),
        F.coalesce(F.max(F.when(end, F.col("status"))), F.lit("running")).alias("status"))
    return paired.withColumn("duration_ms", F.coalesce("_duration", F.col("ended_ms") - F.col("started_ms"))).drop("_duration")


def durations_by_kind(durations: DataFrame) -> DataFrame:
    """BI8: sum per run and kind, plus the run's total time."""
    return durations.groupBy("run_id", "kind").agg(
        F.sum("duration_ms").alias("total_ms"), F.count(F.lit(1)).alias("steps"),
        F.count_if(F.col("status") == "error").alias("errors"))


def run_totals(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run_id").agg(F.max("elapsed_ms").alias("run_ms"))


def config_view(entries: DataFrame) -> DataFrame:
    """BI9: active entries as key and content."""
    return entries.filter("is_active").select("key", "content")


def compare_extractions(before: DataFrame, after: DataFrame) -> DataFrame:
    """BI10: pages and average length per tenant of two extractions."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias(f"{name}_pages"),
                                           F.avg(F.length("content")).alias(f"{name}_avg_len"))

    joined = side(before, "before").join(side(after, "after"), "tenant_id", "full_outer")
    return joined.withColumn("before_pages", F.coalesce("before_pages", F.lit(0).cast("long"))) \
        .withColumn("after_pages", F.coalesce("after_pages", F.lit(0).cast("long")))
