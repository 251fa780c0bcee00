"""Registered extraction and crawl queries (EX, CR) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators import crawl as cr
from corpusflow.operators import extract as ex
from corpusflow.operators.report import render_signals
from corpusflow.plans.tables import table
from corpusflow.sources.sitemap import sitemap_urls


def _pages(spark, sf):
    return table(spark, sf, "pages")


def ex1_resource_filter(spark, sf):
    return _pages(spark, sf).select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit(".PDF")))
                                    .otherwise(F.col("url")).alias("url")).filter(~ex.is_resource(F.col("url")))


def ex2_parsed_pages(spark, sf):
    parsed = ex.parse_pages(_pages(spark, sf), "plain", ["page_id"])
    return parsed.select("page_id", "title", F.sha2("content", 256).alias("content_hash"),
                         F.length("content").cast("long").alias("n"), F.size("links").cast("long").alias("n_links"))


def ex5_title(spark, sf):
    return ex.parse_pages(_pages(spark, sf), "plain", ["page_id"]).select("page_id", "title")


def ex6_clean_text(spark, sf):
    text = F.concat(F.lit("\t\n "), F.replace(F.replace(F.col("text"), F.lit("."), F.lit("\n\n\n\n")), F.lit(","), F.lit(" \t ")))
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.clean(text), 256).alias("hash"))


def ex7_min_length(spark, sf):
    return table(spark, sf, "documents").filter(F.length("text") >= ex.MIN_CONTENT).select("doc_id")


def ex8_truncate(spark, sf):
    cut = tx.truncate_sentence(F.col("text"), 1500, 1200)
    mid = tx.truncate_for_embedding(F.col("text"), 2000)
    return table(spark, sf, "documents").select("doc_id", F.length(cut).cast("long").alias("n"), F.sha2(cut, 256).alias("hash"),
                                                F.length(mid).cast("long").alias("m"), F.sha2(mid, 256).alias("mid_hash"))


def ex11_render_signals(spark, sf):
    html = F.concat(F.col("html"), F.when(F.col("page_id") % 4 == 0, '<img Loading="lazy">').otherwise(""))
    return _pages(spark, sf).select("page_id", F.array_join(render_signals(html), "|").alias("signals"))


def ex12_tenant_derivation(spark, sf):
    urls = _pages(spark, sf).withColumn("url", F.regexp_replace("url", "//(m|blog)\\.", "//www."))
    out = ex.derive_tenants(urls.select("page_id", "url"))
    return out.select("page_id", "tenant_id", "name", "domain", F.array_join("allowed_domains", "|").alias("allowed"))


def ex_extract_chunks(spark, sf):
    return ex.extract_chunks(_pages(spark, sf)).select(
        "chunk_id", "tenant_id", "source_url", F.length("content").cast("long").alias("n"), "language")


def ex10_links(spark, sf):
    return ex.extract_links(_pages(spark, sf)).select("url", "position", "link")


def ex14_embed(spark, sf):
    out = ex.embed_texts(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", F.size("embedding").cast("long").alias("dims"),
                      F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("length"))


# ---------------------------------------------------------------- crawl

def _graph(spark, sf):
    """Links derived from the page numbers: two per page, three tenants."""
    pages = _pages(spark, sf).select("page_id")
    n = pages.count()
    tenant = F.concat(F.lit("t"), F.col("page_id") % 3)
    edges = pages.select(tenant.alias("tenant_id"), F.concat(F.lit("/P"), "page_id").alias("url"), F.posexplode(F.array(
        (F.col("page_id") * 2 + 1) % n, (F.col("page_id") * 3 + 2) % n, F.col("page_id"))).alias("position", "target"))
    every = F.explode(F.array(*[F.lit(f"t{i}") for i in range(3)]))
    edges = edges.select(every.alias("tenant_id"), "url", "position", F.concat(F.lit("/P"), "target").alias("link"))
    seeds = pages.filter("page_id < 3").select(tenant.alias("tenant_id"), F.concat(F.lit("/P"), "page_id").alias("url"))
    fetched = pages.filter("page_id % 5 <> 2").select(every.alias("tenant_id"), F.concat(F.lit("/P"), "page_id").alias("url"))
    return seeds, edges, fetched


def cr1_bfs(spark, sf):
    seeds, edges, _ = _graph(spark, sf)
    return cr.crawl_bfs(seeds, edges, max_depth=4, max_pages=None).select("tenant_id", "url", "depth")


def cr1_bfs_capped(spark, sf):
    seeds, edges, fetched = _graph(spark, sf)
    return cr.crawl_bfs(seeds, edges, fetched, max_depth=5, max_pages=10).select("tenant_id", "url", "depth")


def _crawled(spark, sf):
    """Documents as crawled chunks of some hundred sites."""
    return table(spark, sf, "documents").select(
        F.concat(F.lit("t"), F.col("doc_id") % 7, F.lit("_"), F.col("doc_id") * F.col("doc_id") % 50).alias("tenant_id"),
        F.col("text").alias("content"), F.concat(F.lit("https://Site/"), "doc_id").alias("source_url"),
        (F.col("n_chars") % 4 != 0).alias("is_active"))


def _sitemap_docs(spark, sf):
    """Per supplier: an index with two children, a plain map with foreign hosts, or a broken file."""
    key = F.col("s_suppkey")
    site = F.concat(F.lit("https://s"), key, F.lit(".example.com"))
    entries = F.array_join(F.transform(F.sequence(F.lit(1), (key % 7 + 1).cast("int")), lambda i: F.concat(
        F.lit("<url><lastmod>x</lastmod><loc> "), F.when(i == 3, "https://other.example.com").otherwise(site), F.lit("/p?a=1&amp;b="), i, F.lit(" </loc></url>"))), "\n")
    s = table(spark, sf, "supplier")
    plain = s.select(F.concat(site, F.when(key % 3 == 0, "/child.xml").otherwise("/sitemap.xml")).alias("sitemap_url"),
                     F.when(key % 5 == 4, F.concat(F.lit("<urlset>"), entries)).otherwise(F.concat(F.lit("<?xml version='1.0'?><urlset xmlns='x'>"), entries, F.lit("</urlset>\n"))).alias("xml"))
    index = s.filter(key % 3 == 0).select(F.concat(site, F.lit("/sitemap_index.xml")).alias("sitemap_url"), F.concat(
        F.lit("<sitemapindex><sitemap><loc>"), site, F.lit("/child.xml</loc></sitemap><sitemap><loc>"), site, F.lit("/none.xml</loc></sitemap></sitemapindex>")).alias("xml"))
    return plain.unionByName(index)


def src8_sitemap_urls(spark, sf):
    from corpusflow.sources.tables import sitemap_candidates

    s = table(spark, sf, "supplier").select(F.concat(F.lit("t"), "s_suppkey").alias("tenant_id"),
                                            F.concat(F.lit("s"), "s_suppkey", F.lit(".example.com")).alias("host"))
    candidates = sitemap_candidates(s.withColumn("base_url", F.concat(F.lit("https://"), "host", F.lit("/")))) \
        .select("tenant_id", "priority", "sitemap_url")
    return sitemap_urls(_sitemap_docs(spark, sf), candidates, s)


def cr3_sitemap_crawl(spark, sf):
    pages = _pages(spark, sf)
    urls = pages.select(F.lit("t").alias("tenant_id"), "url").unionByName(
        pages.select(F.lit("t").alias("tenant_id"), F.concat("url", F.lit(".pdf")).alias("url")))
    existing = pages.filter("page_id % 3 = 0").select(F.lit("t").alias("tenant_id"), F.upper("url").alias("source_url"), F.lit(True).alias("is_active"))
    return cr.crawl_sitemap(urls, pages, existing).select("tenant_id", "source_url", F.length("content").cast("long").alias("n"))


def cr4_incremental_urls(spark, sf):
    crawled = _crawled(spark, sf)
    candidates = crawled.select("tenant_id", F.lower("source_url").alias("url")).unionByName(
        crawled.select("tenant_id", F.concat("source_url", F.lit("/x")).alias("url")))
    return cr.new_urls(candidates, crawled)


def cr5_plan(spark, sf):
    crawled = _crawled(spark, sf)
    tenants = crawled.select("tenant_id").distinct()
    return cr.crawl_plan(tenants, crawled.filter("length(content) > 3000"), F.col("tenant_id").endswith("1"))


def _chunk_rows(spark, sf, shift: int):
    return _crawled(spark, sf).select(
        F.sha2(F.concat_ws("|", "tenant_id", "source_url"), 256).alias("chunk_id"), "tenant_id", "source_url", F.lit("T").alias("title"),
        F.expr(f"substring(content, {1 + shift})").alias("content"), F.lit("de").alias("language"), "is_active",
        F.lit(None).cast("array<float>").alias("embedding"), F.lit(shift).alias("crawled_at"))


def cr6_recrawl(spark, sf):
    old = _chunk_rows(spark, sf, 0)
    fresh = _chunk_rows(spark, sf, 3).filter("source_url LIKE '%1' AND tenant_id LIKE 't1%'")
    return cr.recrawl(old, fresh, fresh.select("tenant_id").distinct(), False).select("tenant_id", "source_url", "content", "crawled_at")


def _expected(spark, sf):
    return _crawled(spark, sf).groupBy("tenant_id").agg((F.max(F.length("source_url")) * F.count(F.lit(1)) / 6).cast("long").alias("expected"))


def cr7_quality_verdict(spark, sf):
    crawled = _crawled(spark, sf)
    out = cr.quality_verdict(crawled.select("tenant_id").distinct(), crawled.filter("is_active AND length(content) < 2500"), _expected(spark, sf))
    return out.select("tenant_id", "pages", F.round("avg_length", 4).alias("avg_length"), "expected", "reason", "retry")


def _site_pages(spark, sf):
    return _pages(spark, sf).select(F.concat(F.lit("t"), F.col("page_id") % 40).alias("tenant_id"), "url", "html", "page_id")


def cr8_rendered_retry(spark, sf):
    pages = _site_pages(spark, sf)
    chunks = ex.extract_chunks(pages)
    tenants = pages.select("tenant_id").distinct()
    expected = pages.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("expected"))
    verdicts = cr.quality_verdict(tenants, chunks, expected)
    return cr.retry_rendered(pages, chunks, verdicts).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars"))


def cr9_job_progress(spark, sf):
    crawled = _crawled(spark, sf).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))
    results = crawled.select(F.substring("tenant_id", 1, 2).alias("job_id"), "tenant_id",
                             F.when(F.col("n") > 2, F.col("n")).alias("pages"), F.when(F.col("n") == 2, "timeout").alias("error"))
    return cr.job_progress(results)


QUERIES = {f.__name__: f for f in (
    ex1_resource_filter, ex2_parsed_pages, ex5_title, ex6_clean_text, ex7_min_length, ex8_truncate, ex10_links,
    ex11_render_signals, ex12_tenant_derivation, ex_extract_chunks, ex14_embed, src8_sitemap_urls, cr1_bfs,
    cr1_bfs_capped, cr3_sitemap_crawl, cr4_incremental_urls, cr5_plan, cr6_recrawl, cr7_quality_verdict,
    cr8_rendered_retry, cr9_job_progress)}

_BFS = """g AS (SELECT page_id, unnest([(page_id * 2 + 1) % n, (page_id * 3 + 2) % n, page_id]) AS target, unnest([0, 1, 2]) AS pos
        FROM pages, (SELECT count(*) AS n FROM pages)),
    walk AS (SELECT page_id % 3 AS t, page_id, 0 AS depth, [0] AS path FROM pages WHERE page_id < 3
        UNION SELECT t, target, depth + 1, list_append(path, pos) FROM walk JOIN g USING (page_id) WHERE depth < {depth}),
    visit AS (SELECT t, page_id, min(depth) AS depth, min([depth] || path) AS path FROM walk GROUP BY ALL)"""
_CRAWLED = """crawled AS (SELECT 't' || (doc_id % 7) || '_' || (doc_id * doc_id % 50) AS tenant_id, text AS content,
    'https://Site/' || doc_id AS source_url, n_chars % 4 <> 0 AS is_active FROM documents)"""
# every page of the tables has its content in <main> or <article>; boilerplate is not nested
_PARSED = r"""raw AS (SELECT page_id, url, regexp_replace(html, '(?s)<(script|style|nav|header|footer|aside|form|iframe)\b.*?</(script|style|nav|header|footer|aside|form|iframe)>', '<x>', 'g') AS h,
        regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS rawtitle FROM pages),
    roots AS (SELECT *, CASE WHEN contains(h, '<main') THEN regexp_extract(h, '(?s)<main[^>]*>(.*?)</main>', 1) ELSE regexp_extract(h, '(?s)<article[^>]*>(.*?)</article>', 1) END AS root FROM raw),
    nodes AS (SELECT page_id, url, rawtitle, array_to_string(list_filter(list_transform(string_split_regex(root, '<!--.*?-->|<[^>]*>'),
        lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: length(x) > 3), chr(10)) AS c FROM roots),
    decoded AS (SELECT page_id, url, replace(replace(replace(replace(replace(rawtitle, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&amp;', '&') AS t,
        replace(replace(replace(replace(replace(c, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&amp;', '&') AS c FROM nodes),
    parsed AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS title,
        regexp_replace(regexp_replace(regexp_replace(c, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t\r\f\v\x{A0}]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS content FROM decoded),
    host AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages)"""
_CHUNKS = f"""{_PARSED}, made AS (SELECT sha256('hotel_' || replace(regexp_replace(host, '^www\\.', ''), '.', '_') || '|' || url) AS chunk_id,
    'hotel_' || replace(regexp_replace(host, '^www\\.', ''), '.', '_') AS tenant_id, url AS source_url, page_id, title,
    content
    FROM parsed JOIN host USING (page_id) WHERE length(content) >= 50)"""

SQL = {
    "ex1_resource_filter": """WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '[?#].*$', '') || '.PDF' ELSE url END AS url FROM pages)
        SELECT * FROM u WHERE page_id % 3 <> 0 AND NOT regexp_matches(lower(url), '\\.(jpg|jpeg|png|gif|bmp|svg|webp|ico|tiff|tif|mp4|avi|mov|wmv|flv|webm|mkv|m4v|mpg|mpeg|mp3|wav|ogg|m4a|flac|aac|wma|pdf|zip|rar|7z|tar|gz|doc|docx|xls|xlsx|ppt|pptx|css|js|xml|json|csv)$')""",
    "ex5_title": """SELECT page_id, trim(regexp_replace(html_unescape_amp, '[\\s]+', ' ', 'g')) AS title FROM (
        SELECT page_id, replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS html_unescape_amp FROM pages)""",
    "ex6_clean_text": """WITH t AS (SELECT doc_id, chr(9) || chr(10) || ' ' || replace(replace(text, '.', repeat(chr(10), 4)), ',', ' ' || chr(9) || ' ') AS t FROM documents)
        SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t\\r\\f\\v\\x{A0}]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS hash FROM t""",
    "ex7_min_length": "SELECT doc_id FROM documents WHERE length(text) >= 50",
    "ex8_truncate": """WITH c AS (SELECT doc_id, text, substr(text, 1, 1500) AS a, substr(text, 1, 2000) AS b FROM documents),
        l AS (SELECT *, CASE WHEN contains(a, '.') THEN length(a) - instr(reverse(a), '.') ELSE -1 END AS pa,
            CASE WHEN contains(b, '.') THEN length(b) - instr(reverse(b), '.') ELSE -1 END AS pb FROM c),
        r AS (SELECT doc_id, CASE WHEN length(text) <= 1500 THEN text WHEN pa > 1200 THEN substr(a, 1, pa + 1) ELSE a END AS x,
            CASE WHEN length(text) <= 2000 THEN text WHEN pb > 1600 THEN substr(b, 1, pb + 1) ELSE b || '...' END AS y FROM l)
        SELECT doc_id, length(x) AS n, sha256(x) AS hash, length(y) AS m, sha256(y) AS mid_hash FROM r""",
    "ex2_parsed_pages": f"""WITH {_PARSED}, l AS (SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS n_links FROM pages)
        SELECT page_id, title, sha256(content) AS content_hash, length(content) AS n, n_links::BIGINT AS n_links FROM parsed JOIN l USING (page_id)""",
    "ex_extract_chunks": f"WITH {_CHUNKS} SELECT chunk_id, tenant_id, source_url, length(content) AS n, 'de' AS language FROM made",
    "ex14_embed": "SELECT doc_id, 64::BIGINT AS dims, 1.0::DOUBLE AS length FROM documents",
    "ex10_links": """WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
            unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS o FROM pages),
        f AS (SELECT page_id, url, href, min(o) AS o FROM l GROUP BY ALL),
        r AS (SELECT url, (row_number() OVER (PARTITION BY page_id ORDER BY o) - 1)::INTEGER AS position, regexp_extract(url, '^https?://[^/]+') || href AS link FROM f)
        SELECT url, position, link FROM r WHERE NOT contains(link, '#')""",
    "cr3_sitemap_crawl": f"WITH {_CHUNKS} SELECT 't' AS tenant_id, source_url, length(content) AS n FROM made WHERE page_id % 3 <> 0",
    "cr4_incremental_urls": f"""WITH {_CRAWLED}, c AS (SELECT tenant_id, lower(source_url) AS url FROM crawled UNION ALL SELECT tenant_id, source_url || '/x' FROM crawled)
        SELECT tenant_id, url FROM c WHERE (tenant_id, lower(url)) NOT IN (SELECT (tenant_id, lower(source_url)) FROM crawled WHERE is_active)""",
    "cr5_plan": f"""WITH {_CRAWLED} SELECT tenant_id, CASE WHEN count(*) FILTER (length(content) > 3000) > 0 THEN 'sitemap' WHEN right(tenant_id, 1) = '1' THEN 'nothing' ELSE 'links' END AS mode
        FROM crawled GROUP BY tenant_id""",
    "cr6_recrawl": f"""WITH {_CRAWLED}, fresh AS (SELECT * FROM crawled WHERE source_url LIKE '%1' AND tenant_id LIKE 't1%')
        SELECT tenant_id, source_url, content, 0 AS crawled_at FROM crawled WHERE tenant_id NOT IN (SELECT tenant_id FROM fresh)
        UNION ALL SELECT tenant_id, source_url, substr(content, 4), 3 FROM fresh""",
    "cr7_quality_verdict": f"""WITH {_CRAWLED}, e AS (SELECT tenant_id, CAST(floor(max(length(source_url)) * count(*) / 6) AS BIGINT) AS expected FROM crawled GROUP BY ALL),
        s AS (SELECT tenant_id, count(*) FILTER (is_active AND length(content) < 2500) AS pages,
            coalesce(avg(length(content)) FILTER (is_active AND length(content) < 2500), 0) AS avg_length FROM crawled GROUP BY ALL),
        r AS (SELECT *, CASE WHEN pages < 3 THEN 'few_pages' WHEN expected > 0 AND pages < expected * 0.2 THEN 'low_coverage'
            WHEN avg_length < 500 THEN 'short_content' END AS reason FROM s JOIN e USING (tenant_id))
        SELECT tenant_id, pages, round(avg_length, 4) AS avg_length, expected, reason, reason IS NOT NULL AS retry FROM r""",
    "cr8_rendered_retry": f"""WITH {_CHUNKS} SELECT 't' || (page_id % 40) AS tenant_id, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars
        FROM made GROUP BY ALL""",
    "cr9_job_progress": f"""WITH {_CRAWLED}, n AS (SELECT tenant_id, count(*) AS n FROM crawled GROUP BY ALL)
        SELECT substr(tenant_id, 1, 2) AS job_id, count(*) AS total, count(*) FILTER (n >= 2) AS processed, count(*) FILTER (n > 2) AS succeeded,
        count(*) FILTER (n = 2) AS failed, CAST(coalesce(sum(n) FILTER (n > 2), 0) AS BIGINT) AS pages,
        CASE WHEN count(*) FILTER (n >= 2) < count(*) THEN 'running' ELSE 'completed' END AS status FROM n GROUP BY ALL""",
    "ex11_render_signals": """WITH h AS (SELECT page_id, lower(html || CASE WHEN page_id % 4 = 0 THEN '<img Loading="lazy">' ELSE '' END) AS l FROM pages)
        SELECT page_id, concat_ws('|', CASE WHEN contains(l, 'react') THEN 'React' END, CASE WHEN contains(l, 'vue') THEN 'Vue' END,
        CASE WHEN contains(l, 'angular') THEN 'Angular' END, CASE WHEN contains(l, 'next.js') THEN 'Next.js' END,
        CASE WHEN contains(l, 'loading="lazy"') OR contains(l, 'lazyload') THEN 'lazy' END) AS signals FROM h""",
    "ex12_tenant_derivation": """WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(regexp_replace(url, '//(m|blog)\\.', '//www.'), '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages),
        r AS (SELECT *, replace(replace(replace(host, '.at', ''), '.com', ''), '.de', '') AS raw FROM h)
        SELECT page_id, 'hotel_' || replace(host, '.', '_') AS tenant_id, list_reduce(list_transform(regexp_extract_all(raw, '[a-z0-9]+|[^a-z0-9]+'), lambda x: upper(x[1]) || x[2:]), lambda a, b: a || b) AS name,
        host AS domain, host || '|www.' || host AS allowed FROM r""",
    "src8_sitemap_urls": """WITH u AS (SELECT s_suppkey AS k, unnest(range(1, s_suppkey % 7 + 2)) AS i FROM supplier WHERE s_suppkey % 5 <> 4)
        SELECT 't' || k AS tenant_id, 'https://s' || k || '.example.com/p?a=1&b=' || i AS url FROM u WHERE i <> 3""",
    "cr1_bfs": "WITH RECURSIVE " + _BFS.format(depth=4) + " SELECT 't' || t AS tenant_id, '/P' || page_id AS url, depth FROM visit",
    "cr1_bfs_capped": "WITH RECURSIVE " + _BFS.format(depth=5) + """ SELECT 't' || t AS tenant_id, '/P' || page_id AS url, depth FROM visit
        WHERE page_id % 5 <> 2 QUALIFY row_number() OVER (PARTITION BY t ORDER BY depth, path) <= 10""",
}
