"""Registered source, sink and report queries (SRC, SNK, BI) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import report as bi
from corpusflow.plans.tables import supplier_tenants, table, vector_chunks, with_
from corpusflow.sources import sinks as snk
from corpusflow.sources import tables as src

AS_OF = "2024-01-20 12:00:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


# ---------------------------------------------------------------- sources

def src1_scan(spark, sf):
    return supplier_tenants(spark, sf).orderBy("tenant_id").select("tenant_id", "name", "region", "is_active")


def src2_key_lookup(spark, sf):
    keys = table(spark, sf, "events").select(
        F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("t"), "user_id")).otherwise(" ").alias("tenant_id"))
    return src.lookup(supplier_tenants(spark, sf), keys, "tenant_id", active_only=True).select("tenant_id", "name")


def src3_domain_match(spark, sf):
    tenants = supplier_tenants(spark, sf).withColumn("allowed_domains", src.parse_json_list("domains_json"))
    hosts = table(spark, sf, "customer").select(
        F.concat(F.lit("WWW.s"), "c_custkey", F.lit(".Example.com")).alias("host")).distinct()
    return src.match_domain(tenants, hosts)


def src4_json_list(spark, sf):
    parsed = src.parse_json_list(F.when(F.col("balance") > 0, F.col("domains_json")))
    return supplier_tenants(spark, sf).select(
        "tenant_id", F.size(parsed).cast("long").alias("n"), F.array_join(parsed, "|").alias("domains"))


def src5_session_turns(spark, sf):
    sessions = table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("session_id"),
        F.to_json(F.array(
            F.struct(F.col("role"), F.col("text").alias("content"), F.lit(True).alias("is_voice_input")),
            F.struct(F.lit("system").alias("role"), F.length("text").cast("string").alias("content"),
                     F.lit(False).alias("is_voice_input")))).alias("messages"))
    return src.explode_sessions(sessions).select("session_id", F.col("turn").cast("long").alias("turn"), "role",
                                                 F.length("content").cast("long").alias("content_len"), "is_voice_input")


def src9_sitemap_candidates(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), F.lit("/")).alias("base_url"))
    return src.sitemap_candidates(pages).select("page_id", F.col("priority").cast("long").alias("priority"), "sitemap_url")


# ---------------------------------------------------------------- sinks

def _chunk_versions(spark, sf):
    chunks = vector_chunks(spark, sf).withColumn("content", F.concat(F.lit("old "), "chunk_id")) \
        .withColumn("language", F.lit("de"))
    existing = chunks.filter("chunk_id % 3 <> 0").withColumn("crawled_at", F.lit(1))
    fresh = chunks.filter("chunk_id % 2 = 0")
    incoming = fresh.withColumn("v", F.lit(1)).unionByName(
        fresh.filter("chunk_id % 4 = 0").withColumn("v", F.lit(2)))
    incoming = incoming.withColumn("content", F.concat(F.lit("new "), F.col("chunk_id"), F.lit(" v"), F.col("v"))) \
        .withColumn("title", F.lit("T")).withColumn("tenant_id", F.lit("x")).withColumn("language", F.lit("en")) \
        .withColumn("crawled_at", F.lit(2))
    return existing, incoming


def snk1_upsert(spark, sf):
    existing, incoming = _chunk_versions(spark, sf)
    return snk.upsert_chunks(existing, incoming, "v").select(
        "chunk_id", "tenant_id", "title", "content", "language", "is_active", "crawled_at")


def _tenant_versions(spark, sf):
    tenants = supplier_tenants(spark, sf).withColumn(
        "api_key", F.when(F.length("tenant_id") > 2, F.concat(F.lit("key-"), "tenant_id")))
    tenants = tenants.withColumn("updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    nr = F.substring("tenant_id", 2, 20).cast("long")
    existing = tenants.filter(nr % 5 != 0)
    incoming = tenants.filter(nr % 2 == 0).withColumn("name", F.concat(F.lit("New "), "name")) \
        .withColumn("latitude", F.when(nr % 4 == 0, F.col("latitude") + 1)) \
        .withColumn("api_key", F.lit(None).cast("string"))
    return existing, incoming


def snk2_upsert_coalesce(spark, sf):
    existing, incoming = _tenant_versions(spark, sf)
    return snk.upsert_tenants(existing, incoming, _as_of()).select(
        "tenant_id", "name", "api_key", F.round("latitude", 4).alias("latitude"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


def snk3_session_upsert(spark, sf):
    turns = table(spark, sf, "conversations")
    existing = turns.filter("turn = 0").select(
        F.concat(F.lit("s"), "conv_id").alias("session_id"), F.concat(F.lit("t"), F.col("conv_id") % 7).alias("tenant_id"),
        F.length("text").cast("long").alias("messages"))
    incoming = turns.filter("turn = 1 OR (turn = 0 AND conv_id % 2 = 0)") \
        .select(F.when(F.col("turn") == 1, F.concat(F.lit("s"), "conv_id")).otherwise(F.concat(F.lit("n"), "conv_id"))
                .alias("session_id"), F.lit("other").alias("tenant_id"), (F.length("text") * 10).cast("long").alias("messages"))
    return snk.upsert_sessions(existing, incoming)


def snk4_seed(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("content"))
    merged, _ = snk.insert_absent(part.filter("key % 3 <> 1"), part.withColumn("content", F.upper("content")), ["key"])
    return merged


def snk4_seed_conflicts(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("content"))
    return snk.insert_absent(part.filter("key % 3 <> 1"), part.filter("key % 2 = 0"), ["key"])[1]


def _patches(spark, sf):
    nr = F.substring("tenant_id", 2, 20).cast("long")
    return supplier_tenants(spark, sf).filter(nr % 2 == 0).select(
        "tenant_id", F.when(nr % 3 == 0, " ").otherwise(F.concat(F.lit("P "), "name")).alias("name"),
        F.when(nr % 4 == 0, "").when(nr % 4 == 2, " New ").alias("region"),
        F.when(nr % 5 == 0, F.lit(1.5)).alias("latitude"), F.when(nr % 7 == 0, F.lit(False)).alias("is_active"))


def snk5_patch(spark, sf):
    return snk.patch_tenants(supplier_tenants(spark, sf), _patches(spark, sf)).select(
        "tenant_id", "name", "region", F.round("latitude", 4).alias("latitude"), "is_active")


def snk6_append_marker(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return snk.append_unless_present(docs, {"text": ("the", "\nTHE END"), "source": ("1", "-one")}) \
        .select("doc_id", F.length("text").cast("long").alias("n"), "source", F.col("_changed").alias("changed"))


def snk7_overwrite(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("content"))
    changes = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 30).alias("key"), F.col("s_name").alias("content"))
    return snk.overwrite_columns(part, changes, "key")[0]


def snk7_missing_keys(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("content"))
    changes = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 30).alias("key"), F.col("s_name").alias("content"))
    return snk.overwrite_columns(part, changes, "key")[1]


def snk8_delete(spark, sf):
    keys = supplier_tenants(spark, sf).filter("NOT is_active").select("tenant_id")
    return snk.delete_keys(vector_chunks(spark, sf), keys, "tenant_id").select("chunk_id", "tenant_id")


def snk9_retention(spark, sf):
    sessions = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    return snk.expire_sessions(sessions, F.lit("2024-01-31 00:00:00").cast("timestamp"), 12).select("user_id")


def snk9_job_retention(spark, sf):
    jobs = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "view", "running").otherwise("completed").alias("status"),
        F.col("ts").alias("started_at"),
        F.when(F.col("event_id") % 3 != 0, F.timestamp_add("MINUTE", F.col("event_id").cast("int") % 500, F.col("ts"))).alias("completed_at"))
    return snk.expire_jobs(jobs, _as_of()).select("event_id", "status")


def _feedback(spark, sf):
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("id"), F.concat(F.lit("t"), F.col("o_custkey") % 120).alias("tenant_id"),
        F.col("o_orderpriority").alias("name"), F.when(key % 11 != 0, F.col("o_orderstatus")).otherwise(" ").alias("keyword"),
        F.when(key % 13 != 0, F.concat(F.lit("text "), key)).alias("text"), F.lit("open").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))


def snk10_feedback(spark, sf):
    feedback = _feedback(spark, sf)
    updates = feedback.filter("id % 4 = 1").select(
        "id", F.when(F.col("id") % 8 == 1, "closed").alias("status"), F.upper("text").alias("text"))
    inserts = feedback.filter("id % 10 = 3").withColumn("id", F.col("id") + 1000000)
    return snk.apply_feedback(feedback, inserts, updates, _as_of()).select("id", "tenant_id", "text", "status")


def snk11_enrich(spark, sf):
    tenants = supplier_tenants(spark, sf)
    seed = table(spark, sf, "customer").select(
        F.concat(F.lit("t"), "c_custkey").alias("tenant_id"), F.lower("c_mktsegment").alias("location"))
    return snk.enrich_by_id(tenants, seed, "tenant_id").select("tenant_id", "location", "region")


def snk13_bulk_load(spark, sf):
    existing, incoming = _chunk_versions(spark, sf)
    nr = F.col("chunk_id")
    incoming = incoming.withColumn("tenant_id", F.concat(F.lit("t"), nr % 14)) \
        .withColumn("language", F.when(nr % 6 == 0, "").otherwise("en"))
    tenants = existing.select("tenant_id").distinct()
    return snk.load_chunks(incoming, tenants, existing, "v")[0].select("chunk_id", "tenant_id", "content", "language")


def snk14_evolve(spark, sf):
    df = snk.evolve(table(spark, sf, "supplier"), {"latitude": "double", "categories": "array<string>"})
    return df.select("s_suppkey", "s_name", "latitude", F.size("categories").cast("long").alias("n_categories"))


# ---------------------------------------------------------------- reports

def _document_chunks(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.concat(F.lit("t"), (F.col("doc_id") * F.col("doc_id")) % 97).alias("tenant_id"),
        F.col("text").alias("content"), (F.col("n_chars") > 200).alias("is_active"))


def bi1_stats(spark, sf):
    return bi.content_stats(supplier_tenants(spark, sf), _document_chunks(spark, sf)).select(
        "tenant_id", "name", "chunks", "has_content")


def bi1_totals(spark, sf):
    return bi.content_totals(bi.content_stats(supplier_tenants(spark, sf), _document_chunks(spark, sf)))


def _sitemaps(spark, sf):
    """A sitemap document per supplier; every fourth one is an index over two others."""
    key = F.col("s_suppkey")
    body = F.array_join(F.transform(F.sequence(F.lit(0), (key % 40).cast("int")), lambda i: F.concat(
        F.lit("<url>\n <loc>https://s"), key, F.lit(".example.com/"), i, F.lit("</loc></url>"))), "")
    index = F.concat(F.lit("<SitemapIndex><sitemap><loc> https://s"), key + 1,
                     F.lit(".example.com/sitemap.xml </loc></sitemap><sitemap><LOC>https://s"), key + 2,
                     F.lit(".example.com/sitemap.xml</LOC></sitemap></SitemapIndex>"))
    return table(spark, sf, "supplier").filter(key % 10 != 9).select(
        F.concat(F.lit("https://s"), key, F.lit(".example.com/sitemap.xml")).alias("sitemap_url"),
        F.when(key % 4 == 0, index).when(key % 10 == 3, "<urlset><url>broken").otherwise(F.concat(F.lit("<urlset>"), body, F.lit("</urlset>"))).alias("xml"),
        F.when(key % 10 == 7, "error").alias("status"))


def bi4_sitemap_counts(spark, sf):
    return bi.sitemap_counts(supplier_tenants(spark, sf), _sitemaps(spark, sf))


def _health(spark, sf):
    stats = bi.content_stats(supplier_tenants(spark, sf), _document_chunks(spark, sf))
    return bi.crawl_health(stats, bi.sitemap_counts(supplier_tenants(spark, sf), _sitemaps(spark, sf)))


def bi2_health(spark, sf):
    return _health(spark, sf).select("tenant_id", "chunks", "sitemap_urls", "sitemap_status", "status", "coverage")


def bi3_diagnosis(spark, sf):
    home = table(spark, sf, "pages").groupBy(F.concat(F.lit("t"), F.col("page_id") % 90).alias("tenant_id")) \
        .agg(F.max_by("html", F.col("page_id")).alias("html"))
    return bi.diagnose(_health(spark, sf), home).select(
        "tenant_id", "has_sitemap", F.array_join("findings", "|").alias("findings"), F.array_join("advice", "|").alias("advice"))


def bi5_feedback(spark, sf):
    return bi.feedback_report(_feedback(spark, sf), supplier_tenants(spark, sf)).select("id", "tenant_id", "tenant_name", "keyword")


def bi6_validation(spark, sf):
    return bi.validate_feedback(_feedback(spark, sf), supplier_tenants(spark, sf)).select("id", "tenant_id", "error")


def _query_log(spark, sf):
    return table(spark, sf, "events").select(
        "ts", F.when(F.col("value") > 10, "OK").otherwise("OUT-OF-SCOPE").alias("category"), F.col("event_type").alias("language"))


def bi7_query_log(spark, sf):
    return bi.query_log_report(_query_log(spark, sf)).select(F.col("day").cast("string").alias("day"), "category", "language", "n")


def _steps(spark, sf):
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000)
    return table(spark, sf, "events").select(
        F.concat(F.lit("r"), "user_id").alias("run_id"), F.col("event_type").alias("agent"),
        F.when(F.col("event_type").isin("view", "click"), "db").otherwise("llm").alias("kind"),
        F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("phase"), ms.alias("elapsed_ms"),
        F.when((F.col("event_id") % 2 == 1) & (F.col("event_id") % 3 == 0), F.floor("value")).alias("duration_ms"),
        F.when(F.col("value") > 25, "error").otherwise("ok").alias("status"))


def bi8_durations(spark, sf):
    return bi.step_durations(_steps(spark, sf)).select(
        "run_id", "agent", F.col("occurrence").cast("long").alias("occurrence"), "kind", "duration_ms", "status")


def bi8_by_kind(spark, sf):
    return bi.durations_by_kind(bi.step_durations(_steps(spark, sf)))


def bi9_config_view(spark, sf):
    entries = table(spark, sf, "part").select(F.col("p_name").alias("key"), F.col("p_brand").alias("content"),
                                              (F.col("p_size") > 20).alias("is_active"))
    return bi.config_view(entries)


def bi10_compare(spark, sf):
    chunks = _document_chunks(spark, sf)
    out = bi.compare_extractions(chunks.filter("is_active"), chunks.filter("chunk_id % 3 = 0"))
    return out.select("tenant_id", "before_pages", "after_pages", F.round("before_avg_len", 4).alias("before_avg_len"),
                      F.round("after_avg_len", 4).alias("after_avg_len"))


QUERIES = {f.__name__: f for f in (
    src1_scan, src2_key_lookup, src3_domain_match, src4_json_list, src5_session_turns, src9_sitemap_candidates,
    snk1_upsert, snk2_upsert_coalesce, snk3_session_upsert, snk4_seed, snk4_seed_conflicts, snk5_patch,
    snk6_append_marker, snk7_overwrite, snk7_missing_keys, snk8_delete, snk9_retention, snk9_job_retention,
    snk10_feedback, snk11_enrich, snk13_bulk_load, snk14_evolve, bi1_stats, bi1_totals, bi2_health, bi3_diagnosis,
    bi4_sitemap_counts, bi5_feedback, bi6_validation, bi7_query_log, bi8_durations, bi8_by_kind, bi9_config_view,
    bi10_compare)}

_T = with_("tenants")
_DOCS = """docs AS (SELECT doc_id AS chunk_id, 't' || (doc_id * doc_id) % 97 AS tenant_id, text AS content,
    n_chars > 200 AS is_active FROM documents)"""
_STATS = f"""{_DOCS}, counts AS (SELECT tenant_id, count(*) AS n FROM docs WHERE is_active GROUP BY ALL),
    stats AS (SELECT tenants.*, coalesce(n, 0) AS chunks, coalesce(n, 0) > 0 AS has_content FROM tenants LEFT JOIN counts USING (tenant_id))"""
_MAPS = """maps AS (SELECT s_suppkey AS k, 't' || s_suppkey AS tenant_id, s_suppkey % 10 <> 9 AS present, s_suppkey % 4 = 0 AS idx,
        CASE WHEN s_suppkey % 10 = 9 OR s_suppkey % 4 = 0 OR s_suppkey % 10 = 3 THEN 0 ELSE s_suppkey % 40 + 1 END AS own FROM supplier),
    maps2 AS (SELECT m.*, CASE WHEN m.idx THEN coalesce(a.own, 0) + coalesce(b.own, 0) ELSE m.own END AS urls
        FROM maps m LEFT JOIN maps a ON a.k = m.k + 1 LEFT JOIN maps b ON b.k = m.k + 2),
    mapstat AS (SELECT tenant_id, CASE WHEN present THEN urls ELSE 0 END AS sitemap_urls,
        CASE WHEN k % 10 = 7 THEN 'error' WHEN NOT present THEN 'not_found' WHEN idx AND urls > 0 THEN 'found_index'
        WHEN idx THEN 'found_empty' ELSE 'found' END AS sitemap_status FROM maps2)"""
_HEALTH = f"""{_STATS}, {_MAPS}, health AS (SELECT stats.*, CAST(sitemap_urls AS BIGINT) AS sitemap_urls, sitemap_status,
    CASE WHEN chunks = 0 THEN 'not_crawled' WHEN chunks < 10 THEN 'problematic' WHEN chunks < 30 THEN 'warning' ELSE 'good' END AS status,
    CASE WHEN sitemap_urls > 0 THEN printf('%.1f', chunks::DOUBLE / sitemap_urls * 100) || '%' ELSE 'n/a' END AS coverage
    FROM stats LEFT JOIN mapstat USING (tenant_id))"""
_FEEDBACK = """feedback AS (SELECT o_orderkey AS id, 't' || (o_custkey % 120) AS tenant_id, o_orderpriority AS name,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus ELSE ' ' END AS keyword,
    CASE WHEN o_orderkey % 13 <> 0 THEN 'text ' || o_orderkey END AS text, 'open' AS status FROM orders)"""
_STEPS = """steps AS (SELECT 'r' || user_id AS run_id, event_type AS agent, CASE WHEN event_type IN ('view', 'click') THEN 'db' ELSE 'llm' END AS kind,
        CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END AS phase, epoch_us(ts) - 1704067200000000 AS elapsed_ms,
        CASE WHEN event_id % 2 = 1 AND event_id % 3 = 0 THEN CAST(floor(value) AS BIGINT) END AS duration_ms,
        CASE WHEN value > 25 THEN 'error' ELSE 'ok' END AS status FROM events),
    nth AS (SELECT *, row_number() OVER (PARTITION BY run_id, agent, phase ORDER BY elapsed_ms) AS occurrence FROM steps),
    paired AS (SELECT run_id, agent, occurrence, max(kind) AS kind, coalesce(max(duration_ms) FILTER (phase = 'end'),
        max(elapsed_ms) FILTER (phase = 'end') - max(elapsed_ms) FILTER (phase = 'start')) AS duration_ms,
        coalesce(max(status) FILTER (phase = 'end'), 'running') AS status FROM nth GROUP BY ALL)"""
_OLD_NEW = f"""{with_('chunks')}, existing AS (SELECT *, 'old ' || chunk_id AS content, 'de' AS language FROM chunks WHERE chunk_id % 3 <> 0),
    incoming AS (SELECT chunk_id, 'x' AS tenant_id, 'new ' || chunk_id || ' v' || CASE WHEN chunk_id % 4 = 0 THEN 2 ELSE 1 END AS content,
        is_active FROM chunks WHERE chunk_id % 2 = 0)"""

SQL = {
    "src1_scan": f"{_T} SELECT tenant_id, name, region, is_active FROM tenants",
    "src2_key_lookup": f"""{_T} SELECT tenant_id, name FROM tenants WHERE is_active AND tenant_id IN (
        SELECT 't' || user_id FROM events WHERE user_id % 5 <> 0)""",
    "src3_domain_match": f"""{_T}, h AS (SELECT DISTINCT 'WWW.s' || c_custkey || '.Example.com' AS host FROM customer)
        SELECT host, tenant_id FROM h JOIN tenants ON lower(host) = 'www.' || domain""",
    "src4_json_list": f"""{_T} SELECT tenant_id, CASE WHEN balance > 0 THEN 2 ELSE 0 END::BIGINT AS n,
        CASE WHEN balance > 0 THEN array_to_string(domains_json::JSON->>'$[*]', '|') ELSE '' END AS domains FROM tenants""",
    "src5_session_turns": """SELECT conv_id || '-' || turn AS session_id, 0::BIGINT AS turn, role, length(text) AS content_len, true AS is_voice_input FROM conversations
        UNION ALL SELECT conv_id || '-' || turn, 1, 'system', length(length(text)::VARCHAR), false FROM conversations""",
    "src9_sitemap_candidates": """WITH b AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS base FROM pages),
        c AS (SELECT page_id, [base || '/sitemap.xml', base || '/sitemap_index.xml', regexp_replace(base, '^http:', 'https:') || '/sitemap.xml',
            regexp_replace(base, '^http:', 'https:') || '/sitemap_index.xml'] AS l, base LIKE 'https:%' AS https FROM b)
        SELECT page_id, unnest(range(CASE WHEN https THEN 2 ELSE 4 END)) AS priority, unnest(CASE WHEN https THEN l[1:2] ELSE l END) AS sitemap_url FROM c""",
    "snk1_upsert": f"""{_OLD_NEW} SELECT coalesce(e.chunk_id, i.chunk_id) AS chunk_id, coalesce(e.tenant_id, i.tenant_id) AS tenant_id,
        CASE WHEN i.chunk_id IS NOT NULL THEN 'T' ELSE e.title END AS title, coalesce(i.content, e.content) AS content,
        CASE WHEN e.chunk_id IS NOT NULL THEN 'de' ELSE 'en' END AS language, coalesce(e.is_active, i.is_active) AS is_active,
        CASE WHEN i.chunk_id IS NOT NULL THEN 2 ELSE 1 END AS crawled_at FROM existing e FULL JOIN incoming i ON e.chunk_id = i.chunk_id""",
    "snk2_upsert_coalesce": f"""{_T}, v AS (SELECT *, nr % 5 <> 0 AS o, nr % 2 = 0 AS n FROM tenants)
        SELECT tenant_id, CASE WHEN n THEN 'New ' || name ELSE name END AS name,
        CASE WHEN n THEN '' WHEN length(tenant_id) > 2 THEN 'key-' || tenant_id END AS api_key,
        round(CASE WHEN n AND o THEN CASE WHEN nr % 4 = 0 THEN coalesce(latitude + 1, latitude) ELSE latitude END
            WHEN n THEN CASE WHEN nr % 4 = 0 THEN latitude + 1 END ELSE latitude END, 4) AS latitude,
        CASE WHEN n THEN '2024-01-20' ELSE '2024-01-01' END AS updated FROM v WHERE o OR n""",
    "snk3_session_upsert": """WITH e AS (SELECT 's' || conv_id AS session_id, 't' || (conv_id % 7) AS tenant_id, length(text) AS messages FROM conversations WHERE turn = 0),
        i AS (SELECT CASE WHEN turn = 1 THEN 's' ELSE 'n' END || conv_id AS session_id, length(text) * 10 AS messages FROM conversations
            WHERE turn = 1 OR (turn = 0 AND conv_id % 2 = 0))
        SELECT coalesce(e.session_id, i.session_id) AS session_id, CASE WHEN e.session_id IS NULL THEN 'other' ELSE tenant_id END AS tenant_id,
        coalesce(i.messages, e.messages) AS messages FROM e FULL JOIN i ON e.session_id = i.session_id""",
    "snk4_seed": "SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 1 THEN upper(p_name) ELSE p_name END AS content FROM part",
    "snk4_seed_conflicts": "SELECT p_partkey AS key, p_name AS content FROM part WHERE p_partkey % 3 <> 1 AND p_partkey % 2 = 0",
    "snk5_patch": f"""{_T} SELECT tenant_id, CASE WHEN nr % 2 = 0 AND nr % 3 <> 0 THEN 'P ' || name ELSE name END AS name,
        CASE WHEN nr % 4 = 0 THEN NULL WHEN nr % 4 = 2 THEN 'New' ELSE region END AS region,
        round(CASE WHEN nr % 2 = 0 AND nr % 5 = 0 THEN 1.5 ELSE latitude END, 4) AS latitude,
        CASE WHEN nr % 2 = 0 AND nr % 7 = 0 THEN false ELSE is_active END AS is_active FROM tenants""",
    "snk6_append_marker": """SELECT doc_id, length(text) + CASE WHEN contains(text, 'the') THEN 0 ELSE 8 END AS n,
        CASE WHEN contains(source, '1') THEN source ELSE source || '-one' END AS source,
        NOT contains(text, 'the') OR NOT contains(source, '1') AS changed FROM documents""",
    "snk7_overwrite": "SELECT p_partkey AS key, coalesce(s_name, p_name) AS content FROM part LEFT JOIN supplier ON s_suppkey * 30 = p_partkey",
    "snk7_missing_keys": "SELECT s_suppkey * 30 AS key, s_name AS content FROM supplier WHERE s_suppkey * 30 NOT IN (SELECT p_partkey FROM part)",
    "snk8_delete": f"{with_('tenants', 'chunks')} SELECT chunk_id, tenant_id FROM chunks WHERE tenant_id NOT IN (SELECT tenant_id FROM tenants WHERE NOT is_active)",
    "snk9_retention": "SELECT user_id FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-30 12:00:00'",
    "snk9_job_retention": """SELECT event_id, CASE WHEN event_type = 'view' THEN 'running' ELSE 'completed' END AS status FROM events
        WHERE event_type = 'view' OR CASE WHEN event_id % 3 <> 0 THEN ts + to_minutes(CAST(event_id % 500 AS BIGINT)) ELSE ts END >= TIMESTAMP '2024-01-20 10:00:00'""",
    "snk10_feedback": f"""WITH {_FEEDBACK} SELECT id, tenant_id, CASE WHEN id % 4 = 1 THEN coalesce(upper(text), text) ELSE text END AS text,
        CASE WHEN id % 8 = 1 THEN 'closed' ELSE status END AS status FROM feedback
        UNION ALL SELECT id + 1000000, tenant_id, text, status FROM feedback WHERE id % 10 = 3""",
    "snk11_enrich": f"""{_T} SELECT tenant_id, coalesce(lower(c_mktsegment), location) AS location, region FROM tenants
        LEFT JOIN customer ON 't' || c_custkey = tenant_id""",
    "snk13_bulk_load": f"""{_OLD_NEW}, known AS (SELECT DISTINCT tenant_id FROM existing),
        i AS (SELECT chunk_id, 't' || (chunk_id % 14) AS tenant_id, content, CASE WHEN chunk_id % 6 = 0 THEN 'de' ELSE 'en' END AS language
            FROM incoming WHERE 't' || (chunk_id % 14) IN (SELECT tenant_id FROM known))
        SELECT coalesce(e.chunk_id, i.chunk_id) AS chunk_id, coalesce(e.tenant_id, i.tenant_id) AS tenant_id,
        coalesce(i.content, e.content) AS content, coalesce(e.language, i.language) AS language
        FROM existing e FULL JOIN i ON e.chunk_id = i.chunk_id""",
    "snk14_evolve": "SELECT s_suppkey, s_name, NULL::DOUBLE AS latitude, 0::BIGINT AS n_categories FROM supplier",
    "bi1_stats": f"{_T}, {_STATS} SELECT tenant_id, name, chunks, has_content FROM stats",
    "bi1_totals": f"""{_T}, {_STATS} SELECT coalesce(has_content::VARCHAR, 'total') AS has_content, count(*) AS tenants,
        CAST(sum(chunks) AS BIGINT) AS chunks FROM stats GROUP BY ROLLUP (has_content)""",
    "bi2_health": f"{_T}, {_HEALTH} SELECT tenant_id, chunks, sitemap_urls, sitemap_status, status, coverage FROM health",
    "bi3_diagnosis": f"""{_T}, {_HEALTH}, home AS (SELECT 't' || (page_id % 90) AS tenant_id, max_by(html, page_id) AS html FROM pages GROUP BY ALL),
        s AS (SELECT health.*, html, concat_ws(',', CASE WHEN contains(lower(html), 'react') THEN 'React' END, CASE WHEN contains(lower(html), 'vue') THEN 'Vue' END,
            CASE WHEN contains(lower(html), 'angular') THEN 'Angular' END, CASE WHEN contains(lower(html), 'next.js') THEN 'Next.js' END) AS js,
            coalesce(contains(lower(html), 'loading="lazy"') OR contains(lower(html), 'lazyload'), false) AS lazy,
            sitemap_status IN ('found', 'found_index', 'found_empty') AS has_map FROM health LEFT JOIN home USING (tenant_id)),
        w AS (SELECT *, has_map AND sitemap_urls > 0 AND sitemap_urls > chunks * 2 AS low FROM s)
        SELECT tenant_id, has_map AS has_sitemap, concat_ws('|', 'chunks:' || chunks, CASE WHEN has_map THEN sitemap_status || ':' || sitemap_urls END,
            CASE WHEN low THEN 'low_coverage' END, CASE WHEN sitemap_status = 'not_found' THEN 'no_sitemap' END,
            CASE WHEN sitemap_status = 'error' THEN 'sitemap_error' END, CASE WHEN js <> '' THEN 'js:' || js END, CASE WHEN lazy THEN 'lazy_loading' END,
            CASE WHEN html IS NULL THEN 'unreachable' ELSE 'reachable:' || length(html) END) AS findings,
        concat_ws('|', CASE WHEN low THEN 'try_rendered_profile' END, CASE WHEN sitemap_status = 'not_found' THEN 'crawl_links_deeper' END,
            CASE WHEN js <> '' THEN 'use_rendered_profile' END, CASE WHEN lazy THEN 'use_rendered_profile_lazy' END,
            CASE WHEN html IS NULL THEN 'check_domain' END, CASE WHEN chunks < 10 THEN 'raise_page_limit' END) AS advice FROM w""",
    "bi4_sitemap_counts": f"{_T}, {_MAPS} SELECT tenant_id, CAST(sitemap_urls AS BIGINT) AS sitemap_urls, sitemap_status FROM mapstat",
    "bi5_feedback": f"{_T}, {_FEEDBACK} SELECT id, tenant_id, t.name AS tenant_name, keyword FROM feedback f LEFT JOIN tenants t USING (tenant_id)",
    "bi6_validation": f"""{_T}, {_FEEDBACK} SELECT id, f.tenant_id, CASE WHEN trim(f.tenant_id) = '' THEN 'tenant_id' WHEN trim(f.name) = '' THEN 'name'
        WHEN trim(keyword) = '' THEN 'keyword' WHEN coalesce(trim(text), '') = '' THEN 'text' WHEN t.tenant_id IS NULL THEN 'unknown_tenant' END AS error
        FROM feedback f LEFT JOIN tenants t ON f.tenant_id = t.tenant_id""",
    "bi7_query_log": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN value > 10 THEN 'OK' ELSE 'OUT-OF-SCOPE' END AS category,
        event_type AS language, count(*) AS n FROM events GROUP BY ALL""",
    "bi8_durations": f"WITH {_STEPS} SELECT run_id, agent, occurrence, kind, duration_ms, status FROM paired",
    "bi8_by_kind": f"""WITH {_STEPS} SELECT run_id, kind, CAST(sum(duration_ms) AS BIGINT) AS total_ms, count(*) AS steps,
        count(*) FILTER (status = 'error') AS errors FROM paired GROUP BY ALL""",
    "bi9_config_view": "SELECT p_name AS key, p_brand AS content FROM part WHERE p_size > 20",
    "bi10_compare": f"""WITH {_DOCS}, b AS (SELECT tenant_id, count(*) AS n, avg(length(content)) AS l FROM docs WHERE is_active GROUP BY ALL),
        a AS (SELECT tenant_id, count(*) AS n, avg(length(content)) AS l FROM docs WHERE chunk_id % 3 = 0 GROUP BY ALL)
        SELECT coalesce(a.tenant_id, b.tenant_id) AS tenant_id, coalesce(b.n, 0) AS before_pages, coalesce(a.n, 0) AS after_pages,
        round(b.l, 4) AS before_avg_len, round(a.l, 4) AS after_avg_len FROM a FULL JOIN b ON a.tenant_id = b.tenant_id""",
}
