"""Registered distance and recommendation queries (GE, RC) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow import defaults as d
from corpusflow.operators import geo as ge
from corpusflow.operators import recommend as rc
from corpusflow.operators import retrieve as vs
from corpusflow.plans.tables import (PHRASES, supplier_tenants, table, turns, vector_chunks, vector_queries,
                                     vector_tenants, with_)
from corpusflow.session import cut_lineage, stored


def _located(spark, sf):
    return ge.resolve_coordinates(supplier_tenants(spark, sf))


def ge1_haversine(spark, sf):
    t = _located(spark, sf)
    return t.select("tenant_id", F.round(ge.haversine_km(F.col("lat"), F.col("lng"), F.lit(47.7982), F.lit(13.0465)), 4).alias("km"))


def ge2_coordinates(spark, sf):
    fallback = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(
        F.concat(F.lit("t"), "c_custkey").alias("tenant_id"), F.lit(1.5).alias("latitude"), F.lit(2.5).alias("longitude"))
    return ge.resolve_coordinates(supplier_tenants(spark, sf), fallback).select("tenant_id", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"))


def ge3_nearest_place(spark, sf):
    near = ge.nearest_place(F.col("lat"), F.col("lng"))
    return _located(spark, sf).select("tenant_id", near["name"].alias("place"), F.round(near["km"], 4).alias("km"))


def _intents(spark, sf):
    t = turns(spark, sf).withColumn("query_id", F.concat_ws(":", "session_id", "turn"))
    return ge.prepare(ge.parse_geo(t))


def ge4_places(spark, sf):
    return _intents(spark, sf).select("query_id", F.array_join(F.transform(F.filter("targets", lambda t: t["kind"] == "Place"), lambda t: t["name"]), ";").alias("places"))


def ge5_intent(spark, sf):
    return _intents(spark, sf).select("query_id", F.array_join(F.transform("targets", lambda t: t["name"]), ";").alias("targets"),
                                      "requires_lift", "wants_nearest", "conflicting", "is_geo")


def _text_hits(spark, sf):
    """Text hits of each turn: suppliers of orders that share the turn's number."""
    t = turns(spark, sf).select(F.concat_ws(":", "session_id", "turn").alias("query_id"), F.col("turn"), F.substring("session_id", 2, 20).cast("long").alias("c"))
    every = t.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"), "turn", "c")
    s = table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return every.select("query_id", F.concat(F.lit("t"), (F.col("c") * 7 + F.col("turn") * 3 + F.col("i") * 11) % s).alias("tenant_id"),
                        (F.col("i") + 1).alias("text_rank")).groupBy("query_id", "tenant_id").agg(F.min("text_rank").alias("text_rank"))


def ge6_distance_scores(spark, sf):
    out = ge.distance_scores(_intents(spark, sf), _located(spark, sf), _text_hits(spark, sf))
    return out.select("subject", "tenant_id", F.round("primary_km", 3).alias("primary_km"), "close_enough",
                      F.size("distances").cast("long").alias("n"))


def ge9_conflict(spark, sf):
    geo, tenants = _intents(spark, sf).filter("is_geo"), _located(spark, sf)
    return ge.verdicts(geo, tenants, ge.candidate_scores(geo, tenants, _text_hits(spark, sf), 1))


def ge11_rank_fill(spark, sf):
    return ge.geo_rank(_intents(spark, sf), _located(spark, sf), _text_hits(spark, sf), 4).select(
        "query_id", "tenant_id", F.col("geo_rank").cast("long").alias("geo_rank"), F.round("primary_km", 3).alias("primary_km"), "conflict")


def ge12_backfill(spark, sf):
    """Vector tenants ranked for queries whose own hits miss them."""
    queries, chunks = vector_queries(spark, sf), _content_chunks(spark, sf)
    tenants = vector_tenants(spark, sf).withColumn("lat", F.col("latitude")).withColumn("lng", F.col("longitude"))
    ranked = queries.select("query_id", F.explode(F.array(F.concat(F.lit("t"), F.col("query_id") % 10), F.concat(F.lit("t"), (F.col("query_id") * 3 + 1) % 10))).alias("tenant_id")).distinct()
    hits = vs.search(queries, chunks, 2, 0.2)
    return ge.backfill(ranked, hits, queries, chunks, tenants, 3, 0.3).select(
        "query_id", "tenant_id", "chunk_id", F.round("score", 6).alias("score"), "title", "source_url")


def ge13_briefing(spark, sf):
    ranked = ge.geo_rank(_intents(spark, sf), _located(spark, sf), _text_hits(spark, sf), 3)
    out = ge.briefing(ranked, _intents(spark, sf), supplier_tenants(spark, sf))
    return out.select("query_id", F.size(F.split("briefing", "\n")).cast("long").alias("lines"), F.contains("briefing", F.lit("Conflict")).alias("conflict"))


# ---------------------------------------------------------------- recommendations

def _content_chunks(spark, sf):
    return vector_chunks(spark, sf).withColumn("content", F.concat(F.lit("content of "), "chunk_id"))


def _hits(spark, sf, k=3):
    chunks = _content_chunks(spark, sf)
    hits = vs.search_all(vector_queries(spark, sf), chunks, k, 0.2, candidate_limit=None).drop("rn")
    return cut_lineage(hits.join(chunks.select("chunk_id", "title", "content", "source_url"), "chunk_id"))


def rc1_recommend(spark, sf):
    return rc.recommend(_hits(spark, sf), vector_tenants(spark, sf).filter("is_active"), n=3).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "tenant_id", F.round("match_score", 6).alias("match_score"), "reason",
        F.array_join("sources", "|").alias("sources"), F.array_join("features", "|").alias("features"))


def rc1_recommend_geo(spark, sf):
    geo = vector_queries(spark, sf).filter("query_id % 2 = 0").select(
        "query_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("geo_rank")).select(
        "query_id", F.concat(F.lit("t"), (F.col("query_id") + F.col("geo_rank") * 3) % 10).alias("tenant_id"), "geo_rank",
        (F.col("geo_rank") * 1.26).alias("primary_km"))
    return rc.recommend(_hits(spark, sf), vector_tenants(spark, sf), geo, 3).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "tenant_id", "reason", F.col("distance_km").cast("double").alias("distance_km"))


def rc2_result_count(spark, sf):
    value = F.when(F.col("p_size") % 5 == 0, "x").when(F.col("p_size") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), F.col("p_size") - 5))
    return table(spark, sf, "part").select("p_partkey", rc.result_count(value).alias("n"))


def rc3_context(spark, sf):
    out = rc.assemble_context(_hits(spark, sf), vector_tenants(spark, sf).filter("is_active"), 2)
    return out.select("query_id", F.sha2("context", 256).alias("hash"), F.length("context").cast("long").alias("n"))


def _answers(spark, sf):
    q = vector_queries(spark, sf)
    return q.select("query_id", F.when(F.col("query_id") % 3 == 0, "no names here").otherwise(
        F.concat(F.lit("see hotel NATION_"), F.col("query_id") % 10, F.lit(" or nation_"), (F.col("query_id") + 1) % 10, F.lit("."))).alias("answer"),
        F.when(F.col("query_id") % 2 == 0, "en").otherwise("de").alias("language"))


def rc4_mentions(spark, sf):
    return rc.mentioned_tenants(_answers(spark, sf), _hits(spark, sf), vector_tenants(spark, sf))


def rc5_weighted_sources(spark, sf):
    return rc.weighted_sources(_answers(spark, sf), _hits(spark, sf), vector_tenants(spark, sf), primary=3).select(
        "query_id", "tenant_id", "url", F.round("score", 6).alias("score"), F.col("position").cast("long").alias("position"), "is_primary")


def rc5_section(spark, sf):
    s = rc.weighted_sources(_answers(spark, sf), _hits(spark, sf), vector_tenants(spark, sf), primary=3)
    return rc.sources_section(s, _answers(spark, sf)).select("query_id", F.size(F.split("section", "\n")).cast("long").alias("lines"),
                                                             F.contains("section", F.lit("**Sources:**")).alias("english"))


def rc6_strip_footer(spark, sf):
    text = F.concat(F.lit("A"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, "\n---\n**Quellen:**\n[to be done]\n [to be done] \n")
                    .when(F.col("doc_id") % 3 == 1, "\n**Sources:**\n- https://x ").otherwise("  \n"))
    return table(spark, sf, "documents").select("doc_id", rc.strip_footer(text).alias("answer"))


def rc7_pending(spark, sf):
    """Each turn as a session of its own, by its number with sources held back, new ones or a request, or several of these."""
    t = turns(spark, sf).select(F.concat_ws(":", "session_id", "turn").alias("session_id"), (F.substring("session_id", 2, 20).cast("long") + F.col("turn")).alias("n"), "text")
    pending = t.filter("n % 2 = 0").select("session_id", F.concat(F.lit("old "), "text").alias("url"))
    fresh = t.filter("n % 3 = 0").select("session_id", F.concat(F.lit("new "), "text").alias("url"))
    asked = t.filter("n % 5 < 2").select("session_id")
    returned, kept = rc.pending_sources(fresh, asked, pending)
    return returned.withColumn("kind", F.lit("returned")).unionByName(kept.withColumn("kind", F.lit("kept")))


def _catalog_questions(spark, sf):
    """Customers as questions: each asks for one region, or for none."""
    return table(spark, sf, "customer").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("c_custkey") % 7, "left") \
        .select(F.col("c_custkey").alias("query_id"), F.col("r_name").alias("region"))


def rc8_listings(spark, sf):
    """A listing per region that is asked for, whatever the number of questions; positions are a seeded shuffle."""
    lists, _ = rc.catalog_lists(_catalog_questions(spark, sf), supplier_tenants(spark, sf))
    full = Window.partitionBy("region")
    return lists.select("region", "tenant_id", (F.max("position").over(full) == F.count("*").over(full)).alias("numbered"),
                        F.startswith("line", F.concat(F.col("position").cast("string"), F.lit(". "))).alias("lined"))


def rc8_links(spark, sf):
    """Which listing answers each question."""
    return rc.catalog_lists(_catalog_questions(spark, sf), supplier_tenants(spark, sf))[1]


def rc8_catalog(spark, sf):
    """Which tenants a listing holds (their order is a seeded shuffle)."""
    return _catalog_figures(_catalog_questions(spark, sf), supplier_tenants(spark, sf))


def _catalog_figures(questions, tenants):
    """Figures of the listing that answers each question. Each distinct region is asked for once and its listing is summed up
    before the questions meet it, so no row exists per question and tenant."""
    asked = questions.groupBy("query_id", F.coalesce("region", F.lit("")).alias("region")).agg(F.count(F.lit(1)).alias("times"))
    regions = asked.select("region").distinct().select(F.col("region").alias("query_id"), "region")
    listed = rc.catalog(regions, tenants).groupBy(F.col("query_id").alias("region")).agg(
        F.count(F.lit(1)).alias("n"), F.max("position").alias("last"), F.min("tenant_id").alias("first_id"),
        F.sum(F.substring("tenant_id", 2, 20).cast("long")).alias("id_sum"))
    # a question that comes several times counts each time
    return asked.join(listed, "region").groupBy("query_id").agg(
        F.sum(F.col("times") * F.col("n")).alias("n"), F.max("last").alias("last"), F.min("first_id").alias("first_id"),
        F.sum(F.col("times") * F.col("id_sum")).alias("id_sum"))


def rc9_routing(spark, sf):
    t = turns(spark, sf)
    n = F.col("turn") + F.substring("session_id", 2, 20).cast("long")
    q = t.select("session_id", "turn", F.lit(False).alias("needs_clarification"), (n % 11 != 3).alias("ethical"), (n % 7 != 2).alias("in_scope"),
                 (n % 5 == 1).alias("more_sources"), (n % 2 == 0).alias("has_pending"), (n % 3 == 0).alias("broad_catalog"), (n % 4).alias("n_hits"))
    return rc.route(q).select("session_id", "turn", "response_type", "status")


def rc11_compose(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    q = c.select(k, F.col("c_name").alias("message"), F.when(k % 2 == 0, F.concat(F.lit(" "), "c_mktsegment")).alias("region"),
                 F.when(k % 3 == 0, " ").otherwise("spa").alias("wellness_focus"), F.lit(None).cast("string").alias("travel_dates"),
                 F.when(k % 4 == 0, k % 9).alias("guests"), F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("adults_only"),
                 F.when(k % 6 == 0, "low").alias("budget"), F.when(k % 7 == 0, True).when(k % 7 == 1, False).alias("dogs_allowed"))
    return q.select("c_custkey", rc.compose_query().alias("query"))


def rc12_public_view(spark, sf):
    t = supplier_tenants(spark, sf)
    nr = F.substring("tenant_id", 2, 20).cast("long")
    t = t.withColumn("official_url", F.when(nr % 3 == 0, " ").when(nr % 3 == 1, F.concat(F.lit(" https://x/"), nr))) \
        .withColumn("source_url", F.lit(None).cast("string")).withColumn("editorial_review_status", F.lit(" ok ")) \
        .withColumn("editorial_reviewed_at", F.lit("2024-02-03 10:00:00").cast("timestamp")) \
        .withColumn("categories", F.array(F.lit("a"), F.lit(" "), F.lit("b"))) \
        .withColumn("latitude", F.when(nr % 5 == 0, F.col("latitude") + 90).otherwise(F.col("latitude")))
    return rc.public_view(t).select("tenant_id", "region", F.round("latitude", 4).alias("latitude"), "official_url", "source_url",
                                    "editorial_review_status", "editorial_reviewed_at", F.array_join("categories", ",").alias("categories"))


def rc13_append_sources(spark, sf):
    text = F.concat(F.lit("A"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 1, "\n**Quellen:**\n- https://x").otherwise("\n**Quellen:** none"))
    lines = F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("- "), "source"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "documents").select("doc_id", rc.append_sources(text, lines).alias("answer"))


def rc14_detail(spark, sf):
    return rc.tenant_detail(vector_queries(spark, sf), _content_chunks(spark, sf), vector_tenants(spark, sf), 4, 0.25).select(
        "query_id", "tenant_id", "response_type", F.round("confidence", 6).alias("confidence"), F.array_join("sources", "|").alias("sources"),
        F.sha2("context", 256).alias("hash"))


def rc15_recommend_batch(spark, sf):
    """All sessions answered over documents as chunks, with models trained on the documents."""
    from corpusflow.operators import textmodel as tm
    from corpusflow.operators.extract import embed_texts
    from corpusflow.plans.q_text import _quality, language_model
    from corpusflow.plans.recommend_batch import Models, recommend_batch

    docs = table(spark, sf, "documents")
    chunks = stored(embed_texts(docs.select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("t"), F.col("doc_id") % 10).alias("tenant_id"), F.lit(True).alias("is_active"),
        F.concat(F.lit("Doc "), "doc_id").alias("title"), F.col("text").alias("content"), F.concat(F.lit("https://d/"), "doc_id").alias("source_url"))), "chunks")
    scope = tm.train_binary_nb(_quality(spark, sf).withColumn("label", F.when(F.col("label") == "good", "in_scope").otherwise("out_of_scope")), "in_scope", "out_of_scope")
    models = Models(language_model(spark, sf), scope=scope)
    return recommend_batch(turns(spark, sf), chunks, vector_tenants(spark, sf).withColumn("has_lift", F.lit(False)), models)[0].select(
        "query_id", "language", "response_type", "status", F.array_join("tenants", ",").alias("tenants"), F.length("answer").cast("long").alias("answer_len"))


QUERIES = {f.__name__: f for f in (
    rc15_recommend_batch, ge1_haversine, ge2_coordinates, ge3_nearest_place, ge4_places, ge5_intent, ge6_distance_scores, ge9_conflict,
    ge11_rank_fill, ge12_backfill, ge13_briefing, rc1_recommend, rc1_recommend_geo, rc2_result_count, rc3_context,
    rc4_mentions, rc5_weighted_sources, rc5_section, rc6_strip_footer, rc7_pending, rc8_catalog, rc8_listings, rc8_links, rc9_routing,
    rc11_compose, rc12_public_view, rc13_append_sources, rc14_detail)}


def _hav(lat1, lng1, lat2, lng2):
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2)"
    return f"(12742.0::DOUBLE * atan2(sqrt({a}), sqrt(1 - ({a}))))"


_PLACES = "places(place, kind, plat, plng) AS (VALUES " + ", ".join(f"('{p[0]}', '{p[1]}', {p[2]}::DOUBLE, {p[3]}::DOUBLE)" for p in d.PLACES) + ")"
_T = with_("tenants")
# what each phrase asks for, written down by hand: targets, lift, nearest area
_WANTS = {3: ("Salzburg-Stadt", False), 4: ("Salzburg-Stadt", True), 5: ("Zell am See", False), 9: ("Kaprun", False),
          10: ("Innsbruck;Seefeld", False), 11: ("Mondsee;Skigebiet", False), 18: ("Wien", False), 19: ("Innsbruck;Skigebiet", False)}
_INTENT_ROWS = "(-1, '', false)" + "".join(f", ({i}, '{t}', {str(lift).lower()})" for i, (t, lift) in _WANTS.items())
_SKI = "contains(lower(text), 'ski') OR contains(lower(text), 'schi')"


def _strong(markers):
    return "(" + " OR ".join(f"contains(lower(text), '{m}')" for m in markers) + ")"


_INTENT = f"""{with_('turns')}, wants(pick, names, lift) AS (VALUES {_INTENT_ROWS}),
    asked AS (SELECT session_id || ':' || turn AS query_id, turn, substr(session_id, 2)::BIGINT AS c, text, (substr(session_id, 2)::BIGINT * 3 + turn * 7) % {len(PHRASES)} AS pick FROM turns),
    intents AS (SELECT query_id, turn, c, text, coalesce(names, '') AS names, coalesce(lift, false) AS lift,
        {_strong([m for m in d.STRONG_FILTERS if m not in d.SKI_WORDS])} OR (NOT coalesce(lift, false) AND ({_SKI})) AS mixed,
        contains(coalesce(names, ''), 'Skigebiet') AS nearest, coalesce(names, '') <> '' AS is_geo FROM asked LEFT JOIN wants USING (pick)),
    intents2 AS (SELECT *, len(string_split(names, ';')) - nearest::INT >= 2 OR (is_geo AND (nearest OR lift)) AS conflicting FROM intents)"""
_RANK = f"""{_INTENT}, {_PLACES}, {with_('tenants')[5:]},
    act AS (SELECT tenant_id, has_lift, latitude AS lat, longitude AS lng FROM tenants WHERE is_active AND latitude IS NOT NULL),
    near AS (SELECT tenant_id, has_lift, place, kind, {_hav('lat', 'lng', 'plat', 'plng')} AS km FROM act, places),
    tp AS (SELECT tenant_id, has_lift, place, CASE WHEN kind = 'SkiArea' THEN 20 ELSE 25 END AS lim, km FROM near
        UNION ALL SELECT tenant_id, any_value(has_lift), 'Skigebiet', 20, min(km) FROM near WHERE kind = 'SkiArea' GROUP BY tenant_id),
    hits AS (SELECT query_id, 't' || ((c * 7 + turn * 3 + i * 11) % (SELECT count(*) FROM supplier)) AS tenant_id, min(i + 1) AS text_rank FROM asked, range(5) r(i) GROUP BY ALL),
    subj AS (SELECT DISTINCT CASE WHEN mixed THEN query_id ELSE names || '|' || lift END AS subject, names, lift, conflicting, mixed FROM intents2 WHERE is_geo),
    tgt AS (SELECT subject, lift, conflicting, mixed, unnest(string_split(names, ';')) AS place, unnest(range(len(string_split(names, ';')))) AS pos FROM subj),
    dist AS (SELECT g.subject, g.lift, g.conflicting, g.pos, g.place, p.tenant_id, p.has_lift, p.km, p.lim FROM tgt g JOIN tp p USING (place)
        WHERE NOT mixed OR EXISTS (SELECT 1 FROM hits h WHERE h.query_id = g.subject AND h.tenant_id = p.tenant_id)),
    sc AS (SELECT subject, tenant_id, min(km) AS primary_km, count(*) AS n, max(km) FILTER (pos = 0) AS km1, max(km) FILTER (pos = 1) AS km2,
        bool_and(km <= lim) AND (NOT bool_or(lift) OR bool_or(has_lift)) AS close_enough, bool_or(lift) AS lift, bool_or(has_lift) AS has_lift,
        bool_or(conflicting) AS conflicting FROM dist GROUP BY ALL),
    conf AS (SELECT subject, bool_or(conflicting) AND NOT bool_or(close_enough) AS conflict FROM sc GROUP BY ALL)"""
_ORDER = f"""{_RANK},
    poles AS (SELECT subject, tenant_id, 1 AS ord FROM sc QUALIFY row_number() OVER (PARTITION BY subject ORDER BY km1, primary_km, tenant_id) = 1
        UNION ALL SELECT subject, tenant_id, 2 FROM sc WHERE lift AND has_lift QUALIFY row_number() OVER (PARTITION BY subject ORDER BY km1, primary_km, tenant_id) = 1
        UNION ALL SELECT subject, tenant_id, 3 FROM sc WHERE km2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject ORDER BY km2, primary_km, tenant_id) = 1),
    br AS (SELECT p.* FROM poles p JOIN conf USING (subject) WHERE conflict
        UNION ALL SELECT subject, tenant_id, 10 + row_number() OVER (PARTITION BY subject ORDER BY primary_km, tenant_id) FROM sc),
    qs AS (SELECT query_id, is_geo, mixed, CASE WHEN is_geo THEN CASE WHEN mixed THEN query_id ELSE names || '|' || lift END END AS subject FROM intents2),
    cand AS (SELECT query_id, tenant_id, ord FROM qs JOIN br USING (subject)
        UNION ALL SELECT h.query_id, h.tenant_id, 100000 + text_rank FROM hits h JOIN qs USING (query_id) LEFT JOIN conf USING (subject) WHERE NOT is_geo OR mixed OR conflict IS NULL),
    ranked AS (SELECT query_id, tenant_id, min(ord) AS ord FROM cand GROUP BY ALL)"""
_HITS = f"""{with_('chunks', 'queries', 'vtenants')}, pairs AS (SELECT q.query_id, c.tenant_id, c.chunk_id, c.title, c.source_url, 'content of ' || c.chunk_id AS content,
        round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score, q.tenant_id AS own FROM queries q, chunks c WHERE c.is_active),
    hits AS (SELECT * FROM pairs WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id, tenant_id ORDER BY score DESC, chunk_id) <= 3)"""
_MENTION = f"""{_HITS}, ans AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'no names here' ELSE 'see hotel NATION_' || query_id % 10 || ' or nation_' || (query_id + 1) % 10 || '.' END AS answer FROM queries),
    ht AS (SELECT query_id, tenant_id, name, answer, max(score) AS score FROM hits JOIN vtenants USING (tenant_id) JOIN ans USING (query_id) GROUP BY ALL),
    nm AS (SELECT query_id, tenant_id FROM ht WHERE contains(lower(answer), tenant_id) OR contains(lower(answer), lower(replace(name, 'Hotel ', '')))),
    men AS (SELECT * FROM nm UNION ALL SELECT query_id, tenant_id FROM ht WHERE query_id NOT IN (SELECT query_id FROM nm)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tenant_id) <= 3)"""
_SOURCES = f"""{_MENTION}, u AS (SELECT query_id, tenant_id, lower(source_url) AS k, max(score) AS score, arg_min(source_url, [-score, chunk_id]) AS url FROM hits JOIN men USING (query_id, tenant_id) GROUP BY ALL),
    two AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, tenant_id ORDER BY score DESC, k) <= 2),
    src AS (SELECT query_id, tenant_id, url, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(name), tenant_id, k) AS position FROM two JOIN vtenants USING (tenant_id))"""


def _listed(value: str, key: str, n: int, out: str, source: str = "hits") -> str:
    return f"""{out}_f AS (SELECT query_id, tenant_id, {key} AS k, min([-score, chunk_id]) AS o, arg_min({value}, [-score, chunk_id]) AS v FROM {source} GROUP BY ALL),
        {out}_n AS (SELECT * FROM {out}_f QUALIFY row_number() OVER (PARTITION BY query_id, tenant_id ORDER BY o) <= {n}),
        {out} AS (SELECT query_id, tenant_id, string_agg(v, '|' ORDER BY o) AS {out} FROM {out}_n GROUP BY ALL)"""


SQL = {
    "ge1_haversine": f"{_T} SELECT tenant_id, round({_hav('latitude', 'longitude', '47.7982', '13.0465')}, 4) AS km FROM tenants WHERE latitude IS NOT NULL",
    "ge2_coordinates": f"""{_T} SELECT tenant_id, round(coalesce(latitude, 1.5), 4) AS lat, round(coalesce(longitude, 2.5), 4) AS lng FROM tenants
        WHERE latitude IS NOT NULL OR (nr % 2 = 0 AND nr IN (SELECT c_custkey FROM customer))""",
    "ge3_nearest_place": f"""{_T}, {_PLACES}, x AS (SELECT tenant_id, place, {_hav('latitude', 'longitude', 'plat', 'plng')} AS km FROM tenants, places WHERE kind = 'SkiArea' AND latitude IS NOT NULL)
        SELECT tenant_id, place, round(km, 4) AS km FROM x QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY km, place) = 1""",
    "ge4_places": f"{_INTENT} SELECT query_id, regexp_replace(names, ';?Skigebiet', '') AS places FROM intents2",
    "ge5_intent": f"{_INTENT} SELECT query_id, names AS targets, lift AS requires_lift, nearest AS wants_nearest, conflicting, is_geo FROM intents2",
    "ge6_distance_scores": f"{_RANK} SELECT subject, tenant_id, round(primary_km, 3) AS primary_km, close_enough, n FROM sc",
    "ge9_conflict": f"{_RANK} SELECT subject, conflict FROM conf",
    "ge11_rank_fill": f"""{_ORDER}, fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord, tenant_id) AS geo_rank FROM ranked QUALIFY geo_rank <= 4)
        SELECT query_id, f.tenant_id, geo_rank, round(primary_km, 3) AS primary_km, coalesce(conflict, false) AS conflict
        FROM fin f JOIN qs USING (query_id) LEFT JOIN conf USING (subject) LEFT JOIN sc ON sc.subject = qs.subject AND sc.tenant_id = f.tenant_id""",
    "ge12_backfill": f"""{_HITS}, own AS (SELECT query_id, tenant_id FROM pairs WHERE own = tenant_id AND score >= 0.2),
        rk AS (SELECT query_id, 't' || query_id % 10 AS tenant_id FROM queries UNION SELECT query_id, 't' || (query_id * 3 + 1) % 10 FROM queries),
        bare AS (SELECT * FROM rk WHERE (query_id, tenant_id) NOT IN (SELECT (query_id, tenant_id) FROM own)),
        more AS (SELECT p.* FROM pairs p JOIN bare USING (query_id, tenant_id) WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id, tenant_id ORDER BY score DESC, chunk_id) <= 3)
        SELECT query_id, tenant_id, chunk_id::VARCHAR AS chunk_id, round(score, 6) AS score, title, source_url FROM more
        UNION ALL SELECT query_id, tenant_id, 'geo-meta:' || tenant_id, 0, 'Location', 'https://' || domain FROM bare JOIN vtenants USING (tenant_id)
        WHERE (query_id, tenant_id) NOT IN (SELECT (query_id, tenant_id) FROM more)""",
    "ge13_briefing": f"""{_ORDER}, fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord, tenant_id) AS r FROM ranked QUALIFY r <= 3),
        l AS (SELECT query_id, count(*) AS n, bool_or(conflict) AS conflict FROM fin f JOIN qs USING (query_id) JOIN conf USING (subject)
            JOIN sc ON sc.subject = qs.subject AND sc.tenant_id = f.tenant_id GROUP BY ALL)
        SELECT query_id, 3 + n + lift::INT + conflict::INT AS lines, conflict FROM l JOIN intents2 USING (query_id)""",
    "rc1_recommend": f"""{_HITS}, {_listed('source_url', 'lower(source_url)', 5, 'sources')}, {_listed('title', 'title', 5, 'features')},
        b AS (SELECT query_id, tenant_id, max(score) AS match_score, arg_min(title, [-score, chunk_id]) AS reason FROM hits JOIN vtenants v USING (tenant_id) WHERE v.is_active GROUP BY ALL)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, tenant_id) AS rank, tenant_id, round(match_score, 6) AS match_score, reason, sources, features
        FROM b JOIN sources USING (query_id, tenant_id) JOIN features USING (query_id, tenant_id) QUALIFY rank <= 3""",
    "rc1_recommend_geo": f"""{_HITS}, g AS (SELECT query_id, 't' || (query_id + r * 3) % 10 AS tenant_id, r AS geo_rank FROM queries, range(1, 4) x(r) WHERE query_id % 2 = 0),
        b AS (SELECT query_id, tenant_id, max(score) AS s, arg_min(title, [-score, chunk_id]) AS title FROM hits GROUP BY ALL),
        j AS (SELECT b.*, geo_rank FROM b LEFT JOIN g USING (query_id, tenant_id) WHERE query_id % 2 = 1 OR geo_rank IS NOT NULL)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY geo_rank, s DESC, tenant_id) AS rank, tenant_id,
        CASE WHEN query_id % 2 = 0 THEN 'Distance to requested location' ELSE title END AS reason, round(geo_rank * 1.26, 1)::DOUBLE AS distance_km FROM j QUALIFY rank <= 3""",
    "rc2_result_count": "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 AND p_size % 7 <> 0 AND p_size - 5 BETWEEN 1 AND 20 THEN p_size - 5 ELSE 3 END AS n FROM part",
    "rc3_context": f"""{_HITS}, t AS (SELECT h.*, name, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM hits h JOIN vtenants v USING (tenant_id) WHERE v.is_active QUALIFY r <= 6),
        c AS (SELECT query_id, string_agg('[Result ' || r || '] HotelId: ' || tenant_id || ' | Hotel: ' || name || chr(10) || 'Section: ' || title || chr(10) || content || chr(10) || 'Source URL: ' || source_url,
            chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r) AS c FROM t GROUP BY ALL) SELECT query_id, sha256(c) AS hash, length(c) AS n FROM c""",
    "rc4_mentions": f"{_MENTION} SELECT query_id, tenant_id FROM men",
    "rc5_weighted_sources": f"{_SOURCES} SELECT query_id, tenant_id, url, round(score, 6) AS score, position, position <= 3 AS is_primary FROM src",
    "rc5_section": f"""{_SOURCES} SELECT query_id, 4 + least(count(*), 3) + CASE WHEN count(*) > 3 THEN 2 ELSE 0 END AS lines, query_id % 2 = 0 AS english FROM src GROUP BY ALL""",
    "rc6_strip_footer": """WITH t AS (SELECT doc_id, 'A' || doc_id || CASE doc_id % 3 WHEN 0 THEN chr(10) || '---' || chr(10) || '**Quellen:**' || chr(10) || '[to be done]' || chr(10) || ' [to be done] ' || chr(10)
            WHEN 1 THEN chr(10) || '**Sources:**' || chr(10) || '- https://x ' ELSE '  ' || chr(10) END AS t FROM documents)
        SELECT doc_id, regexp_replace(regexp_replace(t, '(\\n---\\s*)?\\n\\*\\*(Quellen|Sources):\\*\\*\\s*(\\n\\s*\\[to be done\\]\\s*)+', ''), '\\s+$', '') AS answer FROM t""",
    "rc7_pending": f"""{with_('turns')}, t AS (SELECT session_id || ':' || turn AS session_id, substr(session_id, 2)::BIGINT + turn AS n, text FROM turns)
        SELECT session_id, 'old ' || text AS url, CASE WHEN n % 5 < 2 THEN 'returned' ELSE 'kept' END AS kind FROM t WHERE n % 2 = 0 AND (n % 5 < 2 OR n % 3 <> 0)
        UNION ALL SELECT session_id, 'new ' || text, 'kept' FROM t WHERE n % 3 = 0""",
    "rc8_catalog": f"""{_T}, q AS (SELECT c_custkey AS query_id, r_name AS reg FROM customer LEFT JOIN region ON r_regionkey = c_custkey % 7)
        SELECT query_id, count(*) AS n, count(*) AS last, min(tenant_id) AS first_id, CAST(sum(nr) AS BIGINT) AS id_sum FROM q JOIN tenants ON is_active AND (reg IS NULL
        OR contains(lower(coalesce(region, '') || '~' || location || '~' || country || '~' || domain || '~' || tenant_id), lower(reg))) GROUP BY ALL""",
    "rc8_listings": f"""{_T}, q AS (SELECT DISTINCT coalesce(r_name, '') AS region FROM customer LEFT JOIN region ON r_regionkey = c_custkey % 7)
        SELECT q.region, tenant_id, true AS numbered, true AS lined FROM q JOIN tenants t ON is_active AND (q.region = ''
        OR contains(lower(coalesce(t.region, '') || '~' || location || '~' || country || '~' || domain || '~' || tenant_id), lower(q.region)))""",
    "rc8_links": "SELECT c_custkey AS query_id, coalesce(r_name, '') AS region FROM customer LEFT JOIN region ON r_regionkey = c_custkey % 7",
    "rc9_routing": f"""{with_('turns')}, n AS (SELECT session_id, turn, turn + substr(session_id, 2)::BIGINT AS n FROM turns),
        r AS (SELECT session_id, turn, CASE WHEN n % 11 = 3 THEN 'ethical_reject' WHEN n % 7 = 2 THEN 'out_of_scope' WHEN n % 5 = 1 AND n % 2 = 0 THEN 'more_sources'
            WHEN n % 3 = 0 THEN 'catalog' WHEN n % 4 = 0 THEN 'no_results' ELSE 'recommendations' END AS response_type FROM n)
        SELECT *, CASE WHEN response_type IN ('ethical_reject', 'out_of_scope', 'no_results') THEN 'no_match' ELSE 'ok' END AS status FROM r""",
    "rc11_compose": """SELECT c_custkey, concat_ws(' ', c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 <> 0 THEN 'spa' END,
        CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 9 END, CASE c_custkey % 5 WHEN 0 THEN 'adults only' WHEN 1 THEN 'family' END, CASE WHEN c_custkey % 6 = 0 THEN 'low' END,
        CASE c_custkey % 7 WHEN 0 THEN 'dogs' WHEN 1 THEN 'no dogs' END) AS query FROM customer""",
    "rc12_public_view": f"""{_T} SELECT tenant_id, coalesce(region, 'not available') AS region, round(CASE WHEN nr % 5 <> 0 THEN latitude END, 4) AS latitude,
        CASE WHEN nr % 3 = 1 THEN 'https://x/' || nr ELSE 'https://' || domain END AS official_url, 'not available' AS source_url, 'ok' AS editorial_review_status,
        '2024-02-03' AS editorial_reviewed_at, 'a,b' AS categories FROM tenants""",
    "rc13_append_sources": """WITH a AS (SELECT doc_id, source, 'A' || doc_id || CASE WHEN doc_id % 3 = 1 THEN chr(10) || '**Quellen:**' || chr(10) || '- https://x' ELSE chr(10) || '**Quellen:** none' END AS t FROM documents)
        SELECT doc_id, t || CASE WHEN doc_id % 3 <> 1 AND doc_id % 2 = 0 THEN chr(10) || chr(10) || '---' || chr(10) || '**Quellen:**' || chr(10) || '- ' || source ELSE '' END AS answer FROM a""",
    "rc14_detail": f"""{_HITS}, dh AS (SELECT p.*, name, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM pairs p JOIN vtenants v USING (tenant_id)
            WHERE own = tenant_id AND v.is_active AND score >= 0.25 QUALIFY r <= 4), {_listed('source_url', 'source_url', 4, 'sources', 'dh')},
        c AS (SELECT query_id, max(score) AS confidence, string_agg('[Result ' || r || '] HotelId: ' || tenant_id || ' | Hotel: ' || name || chr(10) || 'Section: ' || title || chr(10) || content || chr(10) || 'Source URL: ' || source_url,
            chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r) AS c FROM dh GROUP BY ALL)
        SELECT q.query_id, q.tenant_id, CASE WHEN NOT is_active THEN 'error' WHEN confidence IS NULL THEN 'no_data' ELSE 'detail' END AS response_type,
        round(confidence, 6) AS confidence, coalesce(sources, '') AS sources, sha256(c) AS hash
        FROM queries q JOIN vtenants USING (tenant_id) LEFT JOIN c USING (query_id) LEFT JOIN sources s ON s.query_id = q.query_id""",
}
