"""Registered retrieval queries (VS) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import ivf
from corpusflow.operators import retrieve as vs
from corpusflow.plans.tables import table, vector_chunks, vector_queries, vector_tenants, with_
from corpusflow.session import shared_folder

MIN_SCORE = 0.2


def _out(hits):
    return hits.select("query_id", "tenant_id", "chunk_id", F.round("score", 6).alias("score"), "rn")


def vs1_cosine(spark, sf):
    """Similarity of every vector to the mean vector of its label."""
    e = table(spark, sf, "embeddings")
    centre = e.select("label", F.posexplode("embedding").alias("pos", "x")) \
        .groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m")) \
        .groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centre"))
    return e.join(centre, "label").select("vec_id", F.round(vs.cosine(F.col("embedding"), F.col("centre")), 6).alias("score"))


def vs2_tenant_topk(spark, sf):
    return _out(vs.search(vector_queries(spark, sf), vector_chunks(spark, sf), 5, MIN_SCORE))


def vs3_search_all_grouped_topk(spark, sf):
    tenants = vector_tenants(spark, sf).filter("is_active")
    return _out(vs.search_all(vector_queries(spark, sf), vector_chunks(spark, sf), 3, MIN_SCORE, candidate_limit=240, tenants=tenants))


def vs3_search_all_exact(spark, sf):
    return _out(vs.search_all(vector_queries(spark, sf), vector_chunks(spark, sf), 3, MIN_SCORE, candidate_limit=None))


def vector_index(spark, sf):
    """The stored index of the active chunks with its production settings; vs4_ivf_recall measures them."""
    return ivf.build_index(vector_chunks(spark, sf).filter("is_active"), shared_folder(spark, "index"))


def _found(hits):
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rn")


def vs4_ivf_topk(spark, sf):
    return _found(ivf.search_index(vector_queries(spark, sf), vector_index(spark, sf), 5, MIN_SCORE))


def vs4_ivf_all_lists(spark, sf):
    """Without a bound on the rows read the index must give the exact global top-k."""
    return _found(ivf.search_index(vector_queries(spark, sf), vector_index(spark, sf), 5, MIN_SCORE, read_share=ivf.TABLES))


def _keyword_inputs(spark, sf):
    chunks = table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("tenant_id"), F.col("text").alias("content"),
        F.concat(F.col("lang"), F.lit(" the "), F.col("source")).alias("title"))
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return queries, chunks


def vs5_keyword_topk(spark, sf):
    queries, chunks = _keyword_inputs(spark, sf)
    return _out(vs.keyword_search(queries, chunks, 3, 0.6))


def _state(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("query_id"),
                    F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("t"), F.col("vec_id") % 10)).alias("focus_tenant"),
                    F.array(F.concat(F.lit("t"), (F.col("vec_id") + 1) % 10), F.concat(F.lit("t"), F.col("label")),
                            F.concat(F.lit("t"), (F.col("vec_id") + 4) % 10)).alias("recommended"))


def vs6_followup_merge(spark, sf):
    queries, chunks = vector_queries(spark, sf), vector_chunks(spark, sf)
    hits = vs.search(queries, chunks, 3, MIN_SCORE)
    return vs.followup_merge(hits, _state(spark, sf), queries, chunks, 2, MIN_SCORE) \
        .select("query_id", "tenant_id", "chunk_id", F.round("score", 6).alias("score"))


def vs7_catalog_join(spark, sf):
    hits = vs.search_all(vector_queries(spark, sf), vector_chunks(spark, sf), 2, MIN_SCORE, candidate_limit=None)
    return vs.join_catalog(hits, vector_tenants(spark, sf)).select(
        "query_id", "tenant_id", "chunk_id", "name", "region", F.round("score", 6).alias("score"))


def vs8_chunk_counts(spark, sf):
    return vs.chunk_counts(vector_chunks(spark, sf))


def vs9_existing_urls(spark, sf):
    return vs.existing_urls(vector_chunks(spark, sf))


def vs10_vector_migration(spark, sf):
    e = table(spark, sf, "embeddings")
    raw = e.select("vec_id", "label", F.when(F.col("vec_id") % 2 == 0, F.col("embedding")).alias("embedding"),
                   F.when(F.col("vec_id") % 5 != 1, F.to_json("embedding")).alias("embedding_json"))
    filled = vs.vectors_from_json(raw)
    return filled.groupBy("label").agg(
        F.count(F.lit(1)).alias("total"), F.count("embedding").alias("with_vector"),
        (F.count(F.lit(1)) - F.count("embedding")).alias("without_vector"))


def vs11_relevance_gate(spark, sf):
    queries = vector_queries(spark, sf).select("query_id", "tenant_id", "embedding", (F.col("query_id") % 17 == 3).alias("is_geo"))
    hits = vs.search(queries, vector_chunks(spark, sf), 2, MIN_SCORE)
    return vs.relevance_gate(queries, hits).select("query_id", F.round("best_score", 6).alias("best_score"), "relevance")


def vs12_score_summary(spark, sf):
    hits = vs.search_all(vector_queries(spark, sf), vector_chunks(spark, sf), 2, MIN_SCORE, candidate_limit=None)
    return vs.score_summary(hits, vector_tenants(spark, sf)).select(
        "query_id", "tenant_id", "name", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (
    vs3_search_all_exact, vs1_cosine, vs2_tenant_topk, vs3_search_all_grouped_topk, vs4_ivf_topk, vs4_ivf_all_lists,
    vs5_keyword_topk, vs6_followup_merge, vs7_catalog_join, vs8_chunk_counts, vs9_existing_urls,
    vs10_vector_migration, vs11_relevance_gate, vs12_score_summary)}

_PAIRS = """pairs AS (SELECT q.query_id, q.tenant_id AS own, c.tenant_id, c.chunk_id, c.title, c.source_url,
    round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score
    FROM queries q, chunks c WHERE c.is_active)"""
# the spread of the vectors makes the pair table large; every twin filters by score at once


def _each(k: int) -> str:
    return f"""hits AS (SELECT query_id, tenant_id, chunk_id, score, row_number() OVER (
        PARTITION BY query_id, tenant_id ORDER BY score DESC, chunk_id) AS rn FROM pairs WHERE score >= {MIN_SCORE}
        QUALIFY rn <= {k})"""


SQL = {
    "vs1_cosine": """WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
        m AS (SELECT label, pos, avg(x) AS m FROM p GROUP BY ALL),
        c AS (SELECT label, list(m ORDER BY pos) AS centre FROM m GROUP BY label)
        SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], centre), 6) AS score FROM embeddings JOIN c USING (label)""",
    "vs2_tenant_topk": f"""{with_('chunks', 'queries')}, {_PAIRS}
        SELECT query_id, tenant_id, chunk_id, round(score, 6) AS score, row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM pairs
        WHERE own = tenant_id AND score >= {MIN_SCORE} QUALIFY rn <= 5""",
    "vs3_search_all_grouped_topk": f"""{with_('chunks', 'queries', 'vtenants')}, {_PAIRS},
        near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS c
            FROM pairs WHERE score >= {MIN_SCORE} QUALIFY c <= 240),
        first AS (SELECT query_id, tenant_id, chunk_id, score, row_number() OVER (
            PARTITION BY query_id, tenant_id ORDER BY score DESC, chunk_id) AS rn FROM near QUALIFY rn <= 3),
        missing AS (SELECT query_id, t.tenant_id FROM queries q, vtenants t WHERE t.is_active AND NOT EXISTS (
            SELECT 1 FROM first f WHERE f.query_id = q.query_id AND f.tenant_id = t.tenant_id)
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY t.tenant_id) <= 20),
        more AS (SELECT p.query_id, p.tenant_id, chunk_id, score, row_number() OVER (
            PARTITION BY p.query_id, p.tenant_id ORDER BY score DESC, chunk_id) AS rn
            FROM pairs p JOIN missing m ON p.query_id = m.query_id AND p.tenant_id = m.tenant_id
            WHERE score >= {MIN_SCORE} QUALIFY rn <= 3)
        SELECT query_id, tenant_id, chunk_id, round(score, 6) AS score, rn FROM
        (SELECT * FROM first UNION ALL SELECT * FROM more)""",
    "vs3_search_all_exact": f"""{with_('chunks', 'queries')}, {_PAIRS}, {_each(3)}
        SELECT query_id, tenant_id, chunk_id, round(score, 6) AS score, rn FROM hits""",
    "vs4_ivf_all_lists": f"""{with_('chunks', 'queries')}, {_PAIRS}
        SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM pairs WHERE score >= {MIN_SCORE} QUALIFY rn <= 5""",
    "vs5_keyword_topk": """WITH q AS (SELECT item_id AS query_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS terms FROM benchmark),
        t AS (SELECT query_id, len(terms) AS n, unnest(terms) AS term FROM q),
        c AS (SELECT doc_id AS chunk_id, source AS tenant_id, lower(text) AS content, lower(lang || ' the ' || source) AS title FROM documents),
        d AS (SELECT DISTINCT term FROM t),
        h AS (SELECT term, chunk_id, contains(title, term) AS titled FROM d, c WHERE contains(content, term) OR contains(title, term)),
        s AS (SELECT query_id, chunk_id, count(*)::DOUBLE / max(n) AS share, bool_or(titled) AS titled FROM t JOIN h USING (term) GROUP BY ALL),
        r AS (SELECT query_id, tenant_id, chunk_id, least(1.0, share + CASE WHEN titled THEN 0.2 ELSE 0 END)::DOUBLE AS score FROM s JOIN c USING (chunk_id))
        SELECT query_id, tenant_id, chunk_id, round(score, 6) AS score, row_number() OVER (
        PARTITION BY query_id, tenant_id ORDER BY score DESC, chunk_id) AS rn FROM r WHERE score >= 0.6 QUALIFY rn <= 3""",
    "vs6_followup_merge": f"""{with_('chunks', 'queries')}, {_PAIRS},
        hits AS (SELECT query_id, tenant_id, chunk_id, score FROM pairs WHERE own = tenant_id AND score >= {MIN_SCORE}
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 3),
        l AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 3 <> 0 THEN 't' || (vec_id % 10) END AS a, 't' || ((vec_id + 1) % 10) AS b,
            't' || label AS c, 't' || ((vec_id + 4) % 10) AS d FROM embeddings),
        u AS (SELECT query_id, a AS tenant_id, 1 AS o FROM l WHERE a IS NOT NULL UNION ALL SELECT query_id, b, 2 FROM l
            UNION ALL SELECT query_id, c, 3 FROM l UNION ALL SELECT query_id, d, 4 FROM l),
        g AS (SELECT query_id, tenant_id, min(o) AS o FROM u GROUP BY ALL),
        w AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o) <= 3),
        extra AS (SELECT p.query_id, p.tenant_id, p.chunk_id, p.score FROM pairs p JOIN w ON p.query_id = w.query_id AND p.tenant_id = w.tenant_id
            WHERE p.score >= {MIN_SCORE} QUALIFY row_number() OVER (PARTITION BY p.query_id, p.tenant_id ORDER BY p.score DESC, p.chunk_id) <= 2)
        SELECT query_id, tenant_id, chunk_id, round(score, 6) AS score FROM (SELECT * FROM hits UNION SELECT * FROM extra)""",
    "vs7_catalog_join": f"""{with_('chunks', 'queries', 'vtenants')}, {_PAIRS}, {_each(2)}
        SELECT query_id, tenant_id, chunk_id, name, region, round(score, 6) AS score FROM hits JOIN vtenants USING (tenant_id) WHERE is_active""",
    "vs8_chunk_counts": f"{with_('chunks')} SELECT tenant_id, count(*) AS chunks FROM chunks WHERE is_active GROUP BY ALL",
    "vs9_existing_urls": f"""{with_('chunks')} SELECT tenant_id, min(source_url) AS source_url FROM chunks
        WHERE is_active AND trim(source_url) <> '' GROUP BY tenant_id, lower(source_url)""",
    "vs10_vector_migration": """SELECT label, count(*) AS total, count(*) FILTER (vec_id % 2 = 0 OR vec_id % 5 <> 1) AS with_vector,
        count(*) FILTER (NOT (vec_id % 2 = 0 OR vec_id % 5 <> 1)) AS without_vector FROM embeddings GROUP BY ALL""",
    "vs11_relevance_gate": f"""{with_('chunks', 'queries')}, {_PAIRS},
        b AS (SELECT query_id, max(score) AS best FROM pairs WHERE own = tenant_id AND score >= {MIN_SCORE} GROUP BY ALL)
        SELECT query_id, round(best, 6) AS best_score, CASE WHEN query_id % 17 = 3 OR coalesce(best, -1) >= 0.55
        THEN 'relevant' ELSE 'undecided' END AS relevance FROM queries LEFT JOIN b USING (query_id)""",
    "vs12_score_summary": f"""{with_('chunks', 'queries', 'vtenants')}, {_PAIRS}
        SELECT query_id, tenant_id, name, round(max(score), 6) AS score FROM pairs JOIN vtenants USING (tenant_id)
        WHERE score >= {MIN_SCORE} GROUP BY ALL""",
}
