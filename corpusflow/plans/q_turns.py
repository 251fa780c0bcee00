"""Registered turn and session queries (CT, CS) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow import defaults as d
from corpusflow.operators import sessions as cs
from corpusflow.operators import textmodel as tm
from corpusflow.operators import turns as ct
from corpusflow.plans.q_text import language_model
from corpusflow.plans.tables import table, turns, vector_chunks, vector_queries, vector_tenants, with_


def _tagged(spark, sf):
    return ct.tag_turns(turns(spark, sf), vector_tenants(spark, sf))


def ct1_region(spark, sf):
    return turns(spark, sf).select("session_id", "turn", ct.region_tag(F.col("text")).alias("region"))


def ct2_tenant_name(spark, sf):
    keyed = turns(spark, sf).withColumn("text_id", F.concat_ws(":", "session_id", "turn"))
    return ct.match_tenant(keyed, vector_tenants(spark, sf))


def ct3_references(spark, sf):
    t = F.col("text")
    return turns(spark, sf).select("session_id", "turn", ct.is_deictic(t).alias("deictic"), ct.is_multi_tenant(t).alias("multi"),
                                   ct.is_more_sources(t).alias("more_sources"))


def ct5_catalog(spark, sf):
    t = F.col("text")
    return turns(spark, sf).select("session_id", "turn", ct.is_broad_catalog(t).alias("broad"), ct.has_strong_filter(t).alias("strong"),
                                   ct.has_strong_filter(t, True).alias("strong_no_ski"))


def ct8_choice(spark, sf):
    t = F.col("text")
    return turns(spark, sf).select("session_id", "turn", ct.match_choice(t).alias("choice"), ct.is_affirmative(t).alias("affirmative"))


def ct9_vocab_flags(spark, sf):
    t = F.col("text")
    return turns(spark, sf).select("session_id", "turn", ct.has_german_marker(t).alias("marker"), ct.is_shared_vocabulary(t).alias("shared"),
                                   ct.has_policy_cue(t).alias("cue"))


def _decided(spark, sf):
    model = language_model(spark, sf)
    keyed = turns(spark, sf).filter("role = 'user'").withColumn("key", F.concat_ws(":", "session_id", "turn"))
    decided = tm.decide_language(keyed, model, "key")
    return keyed.join(decided, "key").drop("p")


def ct10_close_languages(spark, sf):
    return _decided(spark, sf).select("session_id", "turn", F.array_join(F.transform(ct.close_languages(F.col("top")), lambda r: r["code"]), ",").alias("close"))


def cs1_language_fold(spark, sf):
    return cs.fold_language(ct.language_features(_decided(spark, sf))).select(
        "session_id", "turn", "language", "source", "locked", "first_unambiguous")


def cs2_constraint_fold(spark, sf):
    return cs.fold_constraints(_tagged(spark, sf)).select("session_id", "turn", "region_state", "focus_tenant", "focus_name")


def cs3_enrich(spark, sf):
    f = cs.fold_constraints(_tagged(spark, sf))
    return f.select("session_id", "turn", cs.enrich_query(F.col("text"), F.col("region_state"), F.col("focus_tenant"), F.col("focus_name")).alias("query"))


def _query_state(spark, sf):
    """A query row per vector with region, focus and text."""
    e = table(spark, sf, "embeddings")
    nation = table(spark, sf, "nation")
    regions = table(spark, sf, "region")
    base = e.join(nation, F.col("n_nationkey") == F.col("vec_id") % 10).join(regions, F.col("r_regionkey") == F.col("vec_id") % 5)
    return base.select(
        F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 4 != 0, F.col("r_name")).alias("region_state"),
        F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("t"), F.col("vec_id") % 10)).alias("focus_tenant"),
        F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("Hotel "), "n_name")).alias("focus_name"),
        F.when(F.col("vec_id") % 6 == 0, "Was gibt es dort?").when(F.col("vec_id") % 6 == 3, F.concat(F.lit("x hotel "), F.lower("n_name"), F.lit(" y")))
        .otherwise("Zimmer").alias("text"), (F.col("vec_id") % 11 == 1).alias("is_geo"))


def cs4_region_filter(spark, sf):
    from corpusflow.operators import retrieve as vs

    hits = vs.search_all(vector_queries(spark, sf), vector_chunks(spark, sf), 2, 0.2, candidate_limit=None).select("query_id", "tenant_id", "chunk_id")
    return cs.filter_hits_by_region(hits, _query_state(spark, sf), vector_tenants(spark, sf))


def cs5_history(spark, sf):
    return cs.recent_history(turns(spark, sf), 3).select("session_id", "turn", "role", F.col("back").cast("long").alias("back"))


def _records(spark, sf):
    t = turns(spark, sf)
    return t.select("session_id", F.when(F.col("turn") % 2 == 0, "constraints").otherwise("language").alias("kind"),
                    F.when(F.col("turn") == 5, "{broken").otherwise(F.to_json(F.struct(F.col("turn").alias("n"), F.upper("role").alias("r")))).alias("payload"),
                    F.col("turn").alias("ts"))


def cs6_latest_state(spark, sf):
    return cs.latest_state(_records(spark, sf), "n long, r string").select("session_id", "kind", F.col("state.n").alias("n"), F.col("state.r").alias("r"))


def cs7_append(spark, sf):
    t = table(spark, sf, "conversations")
    ts = F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn"))
    old = t.select(F.concat(F.lit("s"), "conv_id").alias("session_id"), "role", F.length("text").cast("string").alias("content"), ts.alias("ts"))
    new = t.filter("role = 'user'").select(
        F.concat(F.lit("s"), "conv_id").alias("session_id"), (ts + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.concat(F.lit("q"), "turn").alias("question"),
        F.concat(F.lit("a"), "turn").alias("answer"),
        F.when(F.col("conv_id") % 2 == 0, F.array(F.concat(F.lit("t"), "conv_id"))).otherwise(F.array().cast("array<string>")).alias("recommended"))
    return cs.append_interactions(old, new).select("session_id", "role", "content", F.unix_millis("ts").alias("ms"))


def cs7_compact(spark, sf):
    return cs.compact_state(_records(spark, sf)).select("session_id", "kind", "payload", "ts")


def cs8_focus(spark, sf):
    t = table(spark, sf, "conversations")
    rec = t.select(F.concat(F.lit("s"), "conv_id").alias("session_id"), F.concat(F.lit("t"), F.col("turn") % (F.col("conv_id") % 3 + 1)).alias("tenant_id"),
                   F.concat(F.lit("Name "), F.col("turn") % (F.col("conv_id") % 3 + 1)).alias("tenant_name"))
    state = t.select("conv_id").distinct().select(F.concat(F.lit("s"), "conv_id").alias("session_id"), F.lit("old").alias("focus_tenant"), F.lit("Old").alias("focus_name"))
    return cs.focus_after(rec, state)


def cs9_open(spark, sf):
    t = table(spark, sf, "conversations")
    requests = t.select((F.col("conv_id") * 100 + F.col("turn")).alias("request_id"), F.when(F.col("turn") % 3 != 1, F.concat(F.lit("s"), "conv_id")).alias("session_id"))
    known = t.filter("turn = 0 AND conv_id % 2 = 0").select(F.concat(F.lit("s"), "conv_id").alias("session_id"))
    return cs.open_sessions(requests, known, F.lit("2024-01-01").cast("timestamp")).select("request_id", "session_id", "is_new")


QUERIES = {f.__name__: f for f in (
    ct1_region, ct2_tenant_name, ct3_references, ct5_catalog, ct8_choice, ct9_vocab_flags, ct10_close_languages, cs1_language_fold,
    cs2_constraint_fold, cs3_enrich, cs4_region_filter, cs5_history, cs6_latest_state, cs7_append, cs7_compact, cs8_focus, cs9_open)}


def _re(alternatives, column: str = "lower(text)") -> str:
    body = "|".join(a.replace("'", "''") for a in alternatives)
    return f"regexp_matches({column}, '(^|[^\\p{{L}}\\p{{N}}_])({body})($|[^\\p{{L}}\\p{{N}}_])')"


def _any(markers, column: str = "lower(text)") -> str:
    return "(" + " OR ".join(f"contains({column}, '{m}')" for m in markers) + ")"


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_REGION = "CASE " + " ".join(f"WHEN {_re(aliases)} THEN '{name}'" for name, aliases in d.REGIONS) + " END"
_PLACE_WORDS = [a for p in d.PLACES for a in p[4]]
_PROX = f"({_re(d.PROXIMITY)} AND ({_re(_PLACE_WORDS)} OR ({_re(['salzburg'])} AND NOT contains(lower(text), 'salzburger land') AND NOT contains(lower(text), 'salzburgerland')) OR {_re(d.UNNAMED_SKI_AREA)}))"
_NO_SKI = [m for m in d.STRONG_FILTERS if m not in d.SKI_WORDS]
_STRONG = _any(d.STRONG_FILTERS, "lower(trim(text))")
_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda w: w <> '')"
_ALIAS = ", ".join(f"('{name}', '{code}')" for code, names in d.CHOICE_NAMES for name in names)
_NAMED = """m AS (SELECT t.session_id, t.turn, v.tenant_id, v.name, length(v.name) AS n FROM turns t JOIN vtenants v ON v.is_active AND (
        contains(lower(t.text), v.tenant_id) OR contains(lower(t.text), lower(v.name)) OR regexp_matches(lower(t.text), '(^|[^\\p{L}\\p{N}_])' || lower(replace(v.name, 'Hotel ', '')) || '($|[^\\p{L}\\p{N}_])'))),
    mx AS (SELECT session_id, turn, max(n) AS n FROM m GROUP BY ALL),
    named AS (SELECT session_id, turn, any_value(m.tenant_id) AS tenant_id, any_value(m.name) AS tenant_name FROM m JOIN mx USING (session_id, turn, n) GROUP BY session_id, turn HAVING count(*) = 1)"""
_FOLD = f"""{with_('turns', 'vtenants')}, {_NAMED},
    tag AS (SELECT t.*, {_REGION} AS region, {_re(d.DEICTIC)} AS deictic, n.tenant_id AS nt, n.tenant_name AS nn,
        CASE WHEN n.tenant_id IS NOT NULL THEN n.tenant_id || '|' || n.tenant_name WHEN {_re(d.MULTI_TENANT)} AND NOT {_re(d.DEICTIC)} THEN '|' END AS ev
        FROM turns t LEFT JOIN named n USING (session_id, turn)),
    run AS (SELECT *, last_value(region IGNORE NULLS) OVER w AS region_state, nullif(split_part(last_value(ev IGNORE NULLS) OVER w, '|', 1), '') AS focus_tenant,
        nullif(split_part(last_value(ev IGNORE NULLS) OVER w, '|', 2), '') AS focus_name FROM tag WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"""

SQL = {
    "ct1_region": f"{with_('turns')} SELECT session_id, turn, {_REGION} AS region FROM turns",
    "ct2_tenant_name": f"{with_('turns', 'vtenants')}, {_NAMED} SELECT session_id || ':' || turn AS text_id, tenant_id, tenant_name FROM named",
    "ct3_references": f"{with_('turns')} SELECT session_id, turn, {_re(d.DEICTIC)} AS deictic, {_re(d.MULTI_TENANT)} AS multi, {_re(d.MORE_SOURCES)} AS more_sources FROM turns",
    "ct5_catalog": f"""{with_('turns')} SELECT session_id, turn, {_re(d.BROAD_CATALOG)} AND NOT {_STRONG} AND NOT {_PROX} AS broad, {_STRONG} AS strong,
        {_any(_NO_SKI, "lower(trim(text))")} AS strong_no_ski FROM turns""",
    "ct8_choice": f"""{with_('turns')}, alias(name, code) AS (VALUES {_ALIAS}), w AS (SELECT session_id, turn, unnest({_WORDS}) AS name FROM turns),
        c AS (SELECT session_id, turn, arg_max(code, length(name)) AS choice FROM w JOIN alias USING (name) GROUP BY ALL)
        SELECT t.session_id, t.turn, CASE WHEN length(text) = 2 AND lower(text) IN ({_in(d.LANGUAGES)}) THEN lower(text) ELSE choice END AS choice,
        lower(trim(text)) IN ({_in(d.AFFIRMATIVES)}) AS affirmative FROM turns t LEFT JOIN c USING (session_id, turn)""",
    "ct9_vocab_flags": f"""{with_('turns')}, w AS (SELECT *, {_WORDS} AS w FROM turns)
        SELECT session_id, turn, list_has_any(w, [{_in(d.GERMAN_MARKERS)}]) AS marker, len(w) BETWEEN 1 AND 8 AND NOT list_has_any(w, [{_in(d.GERMAN_MARKERS)}])
        AND len(list_filter(w, lambda x: x LIKE 'hotel%' OR x IN ('spa', 'wellness', 'sauna'))) > 0 AND list_has_all([{_in(d.SHARED_WORDS)}], w) AS shared,
        {_any(d.POLICY_CUES)} AS cue FROM w""",
    "cs2_constraint_fold": f"{_FOLD} SELECT session_id, turn, region_state, focus_tenant, focus_name FROM run",
    "cs3_enrich": f"""{_FOLD}, f AS (SELECT *, focus_tenant IS NOT NULL AND deictic AS df, trim(text) AS q FROM run),
        j AS (SELECT *, CASE WHEN df AND NOT contains(lower(q), lower(focus_name)) THEN focus_name || ' ' ELSE '' END || q AS joined FROM f)
        SELECT session_id, turn, joined || CASE WHEN region_state IS NOT NULL AND NOT df AND NOT contains(lower(joined), lower(region_state)) THEN ' ' || region_state ELSE '' END AS query FROM j""",
    "cs4_region_filter": f"""{with_('chunks', 'queries', 'vtenants')}, pairs AS (SELECT q.query_id, c.tenant_id, c.chunk_id,
            round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score FROM queries q, chunks c WHERE c.is_active),
        hits AS (SELECT * FROM pairs WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id, tenant_id ORDER BY score DESC, chunk_id) <= 2),
        st AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 4 <> 0 THEN r_name END AS reg, CASE WHEN vec_id % 3 = 0 THEN 't' || (vec_id % 10) END AS focus,
            vec_id % 3 <> 0 AND vec_id % 11 <> 1 AND vec_id % 4 <> 0 AS on_ FROM embeddings JOIN region ON r_regionkey = vec_id % 5)
        SELECT query_id, tenant_id, chunk_id FROM hits JOIN st USING (query_id) JOIN vtenants v USING (tenant_id)
        WHERE NOT on_ OR contains(lower(v.region), lower(reg)) OR contains(lower(v.location), lower(reg)) OR coalesce(tenant_id = focus, false)""",
    "cs5_history": f"""{with_('turns')} SELECT session_id, turn, role, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS back FROM turns
        WHERE role IN ('user', 'assistant') QUALIFY back <= 3""",
    "cs6_latest_state": f"""{with_('turns')}, l AS (SELECT session_id, CASE WHEN turn % 2 = 0 THEN 'constraints' ELSE 'language' END AS kind, max(turn) AS turn FROM turns GROUP BY ALL)
        SELECT session_id, kind, CASE WHEN turn <> 5 THEN turn END AS n, CASE WHEN turn <> 5 THEN upper(role) END AS r FROM l JOIN turns USING (session_id, turn)""",
    "cs7_append": """SELECT 's' || conv_id AS session_id, role, length(text)::VARCHAR AS content, (conv_id * 100 + turn) * 1000 AS ms FROM conversations
        UNION ALL SELECT 's' || conv_id, unnest(['user', 'assistant']), unnest(['q' || turn, 'a' || turn]), unnest([0, 1]) + (conv_id * 100 + turn + 3600) * 1000 FROM conversations WHERE role = 'user'
        UNION ALL SELECT 's' || conv_id, 'system', '["t' || conv_id || '"]', 2 + (conv_id * 100 + turn + 3600) * 1000 FROM conversations WHERE role = 'user' AND conv_id % 2 = 0""",
    "cs7_compact": f"""{with_('turns')}, l AS (SELECT session_id, CASE WHEN turn % 2 = 0 THEN 'constraints' ELSE 'language' END AS kind, max(turn) AS turn FROM turns GROUP BY ALL)
        SELECT session_id, kind, CASE WHEN turn = 5 THEN '{{broken' ELSE '{{"n":' || turn || ',"r":"' || upper(role) || '"}}' END AS payload, turn AS ts FROM l JOIN turns USING (session_id, turn)""",
    "cs8_focus": """WITH r AS (SELECT DISTINCT conv_id, turn % (conv_id % 3 + 1) AS k FROM conversations), o AS (SELECT conv_id, min(k) AS k FROM r GROUP BY ALL HAVING count(*) = 1)
        SELECT 's' || conv_id AS session_id, coalesce('t' || k, 'old') AS focus_tenant, coalesce('Name ' || k, 'Old') AS focus_name FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN o USING (conv_id)""",
    "cs9_open": """WITH r AS (SELECT conv_id * 100 + turn AS request_id, turn % 3 <> 1 AND conv_id % 2 = 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0) AS known, conv_id FROM conversations)
        SELECT request_id, CASE WHEN known THEN 's' || conv_id ELSE sha256('session|' || request_id) END AS session_id, NOT known AS is_new FROM r""",
}
