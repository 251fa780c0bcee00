"""RC15: all open questions of many sessions answered in one job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import defaults as d
from corpusflow.operators import geo as ge
from corpusflow.operators import recommend as rc
from corpusflow.operators import retrieve as vs
from corpusflow.operators import sessions as cs
from corpusflow.operators import textmodel as tm
from corpusflow.operators import turns as ct
from corpusflow.operators.extract import embed_texts
from corpusflow.session import cut_lineage

# Search size and thresholds of the recommendation search.
SEARCH_K = 5
SEARCH_MIN = 0.35
FOLLOWUP_K = 5
RELEVANT = 0.55


@dataclass
class Models:
    """Trained models and the pluggable callables. Each callable maps a list of texts to a list."""

    language: tm.NBModel
    scope: tm.NBModel | None = None
    abuse: tm.NBModel | None = None
    hard_markers: list[str] = field(default_factory=list)
    soft_markers: list[str] = field(default_factory=list)
    cues: dict = field(default_factory=lambda: d.DOMAIN_CUES)
    embed: Callable | None = None
    #: questions, ranked lists, contexts -> answers
    answer: Callable[[list[str], list[str], list[str]], list[str]] | None = None
    #: questions, contexts -> whether the context fits, asked only where no score decides; None takes all as fitting
    relevant: Callable[[list[str], list[str]], list[bool]] | None = None
    translate: Callable[[list[str]], list[str]] | None = None


class Batch(NamedTuple):
    responses: DataFrame
    listing: DataFrame
    pending: DataFrame
    state: DataFrame


PENDING = "session_id string, position int, name string, score double, url string"


def extractive_answer(questions: list[str], summaries: list[str], contexts: list[str]) -> list[str]:
    """Default answer: the ranked names with their reasons."""
    return [s for s in summaries]


def _translated(df: DataFrame, translate) -> DataFrame:
    """``search_text``: German questions go on as they are, others through ``translate``; on an
    error the original text stays. Only the rows that need it reach Python."""
    if translate is None:
        return df.withColumn("search_text", F.col("text_to_process"))

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.dropna()
            try:
                out = pd.Series(translate(texts.tolist()), index=texts.index, dtype=object)
            except Exception:  # noqa: BLE001 - the original text is the documented fallback
                out = texts
            yield out.reindex(part.index)

    needs = F.when(F.col("language") != "de", F.col("text_to_process"))
    return df.withColumn("search_text", F.coalesce(run(needs), F.col("text_to_process")))


def understand(turns: DataFrame, tenants: DataFrame, models: Models) -> DataFrame:
    """One row per session: the last user turn with language, state, gates and intent columns."""
    user = turns.filter("role = 'user'").withColumn("key", F.concat_ws(":", "session_id", "turn"))
    decided = user.join(tm.decide_language(user, models.language, "key"), "key").drop("p")
    folded = cs.fold_language(ct.language_features(decided)).select("session_id", "turn", "language", "text_to_process")
    tagged = cs.fold_constraints(ct.tag_turns(user.select("session_id", "turn", "text", "key"), tenants))
    last = user.groupBy("session_id").agg(F.max("turn").alias("turn"))
    asked = tagged.join(last, ["session_id", "turn"], "left_semi").join(folded, ["session_id", "turn"])
    asked = asked.withColumnRenamed("key", "query_id")
    gates = asked.select("query_id", F.col("text_to_process").alias("text"))
    if models.abuse is not None:
        ethical = tm.abuse_gate(gates, models.abuse, models.hard_markers, models.soft_markers, "query_id")
        asked = asked.join(ethical.select("query_id", F.col("passes").alias("ethical")), "query_id")
    else:
        asked = asked.withColumn("ethical", F.lit(True))
    if models.scope is not None:
        scope = tm.scope_gate(gates, models.scope, models.cues, "query_id")
        asked = asked.join(scope.select("query_id", "in_scope"), "query_id")
    else:
        asked = asked.withColumn("in_scope", F.lit(True))
    asked = ge.prepare(ge.parse_geo(_translated(asked, models.translate), "text", "search_text"))
    enriched = cs.enrich_query(F.col("search_text"), F.col("region_state"), F.col("focus_tenant"), F.col("focus_name"))
    asked = asked.withColumn("vector_query", F.when(F.col("is_geo"), F.col("search_text")).otherwise(enriched))
    return embed_texts(asked, "vector_query", "embedding", models.embed)


def recommend_batch(turns: DataFrame, chunks: DataFrame, tenants: DataFrame, models: Models,
                    recommended: DataFrame | None = None, pending: DataFrame | None = None,
                    n: int = rc.DEFAULT_RESULTS, configured: str | None = None) -> Batch:
    """Responses(query_id, session_id, language, response_type, status, tenants, answer), the catalog answers as rows
    (query_id, position, tenant_id, line), and for the next run the sources still held back (``PENDING``) and the state
    (session_id, region_state, focus_tenant, focus_name, tenants) of the sessions asked.

    turns(session_id, turn, role, text); chunks with title, content, source_url and embedding;
    recommended(session_id, tenants array) holds earlier recommendations, pending (``PENDING``) the
    sources held back for a "more sources" request, which returns and clears them. ``configured`` is the configured
    number of results, 1 to 20, and goes before ``n``. A question whose best score is too low for a decision goes through
    ``models.relevant`` with its context; what it rejects has no results. All sessions run together; what several
    branches read is stored once. ``chunks`` are read some ten times and should be a stored table, not vectors still to be made.
    """
    if configured is not None:
        number = configured.strip()
        n = int(number) if number.isdecimal() and 1 <= int(number) <= rc.MAX_RESULTS else rc.DEFAULT_RESULTS
    asked = understand(turns, tenants, models)
    if pending is None:
        pending = turns.sparkSession.createDataFrame([], PENDING)
    held = pending.select("session_id").distinct().withColumn("_held", F.lit(True))
    asked = asked.join(held, "session_id", "left").withColumn("has_pending", F.coalesce("_held", F.lit(False))).drop("_held")
    queries = cut_lineage(asked)
    located = ge.resolve_coordinates(tenants)
    searching = queries.filter("ethical AND in_scope AND NOT broad_catalog AND NOT (more_sources AND has_pending)")
    vectors = searching.select("query_id", "embedding")
    hits = vs.search_all(vectors, chunks, SEARCH_K, SEARCH_MIN, tenants=tenants.filter("is_active")).drop("rn")
    earlier = F.lit(None).cast("array<string>").alias("recommended")
    state = searching.select("query_id", "session_id", "focus_tenant")
    if recommended is not None:
        state = state.join(recommended.select("session_id", F.col("tenants").alias("recommended")), "session_id", "left")
    else:
        state = state.select("*", earlier)
    hits = vs.followup_merge(hits, state, vectors, chunks, FOLLOWUP_K, SEARCH_MIN)
    hits = cs.filter_hits_by_region(vs.join_catalog(hits, tenants).select("query_id", "tenant_id", "chunk_id", "score"), searching, tenants)
    hits = cut_lineage(hits)
    best = hits.groupBy("query_id", "tenant_id").agg(F.max("score").alias("_s"))
    ordered = best.withColumn("text_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_s"), "tenant_id")))
    geo = ge.geo_rank(searching, located, ordered, n)
    full = hits.join(chunks.select("chunk_id", "title", "content", "source_url"), "chunk_id") \
        .withColumn("chunk_id", F.col("chunk_id").cast("string"))
    is_geo = searching.filter("is_geo").select("query_id")
    extra = cut_lineage(ge.backfill(geo.join(is_geo, "query_id", "left_semi"), hits, vectors, chunks, located, n))  # a search that four steps read
    full = full.select(*extra.columns).unionByName(extra)
    recommendations = cut_lineage(rc.recommend(full, tenants, geo, n))
    lists = recommendations.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "tenant_id", "name", "reason"))).alias("_r"))
    ranked = full.join(recommendations.select("query_id", "tenant_id"), ["query_id", "tenant_id"], "left_semi")
    briefing = ge.briefing(geo, searching, tenants)
    context = rc.assemble_context(ranked, tenants, n, briefing)
    counts = full.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    gated = cut_lineage(_gated(vs.relevance_gate(searching.select("query_id", "text", "is_geo"), ranked, RELEVANT).join(context, "query_id"), models.relevant))
    counts = counts.join(gated.filter("fits").select("query_id"), "query_id", "left_semi")
    routed = queries.join(counts, "query_id", "left").join(lists, "query_id", "left").select(
        "query_id", "session_id", "language", "text", "ethical", "in_scope", "more_sources", "broad_catalog", "_r", "region_state", "focus_tenant", "focus_name",
        F.lit(False).alias("needs_clarification"), "has_pending", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))
    routed = cut_lineage(rc.route(routed))
    answered = _answer(routed.filter("response_type = 'recommendations'").join(gated.select("query_id", "context"), "query_id", "left").select(
        "query_id", "text", F.coalesce("context", F.lit("")).alias("context"), F.array_join(F.transform("_r", lambda r: F.concat(r["rank"].cast("string"), F.lit(". "), r["name"], F.lit(": "), r["reason"])), "\n").alias("summary")),
        models.answer or extractive_answer)
    answered = cut_lineage(answered)
    sources = cut_lineage(rc.weighted_sources(answered, full, tenants))
    sections = rc.sources_section(sources, routed.select("query_id", "language"))
    listing = rc.catalog(routed.filter("response_type = 'catalog'").select("query_id", F.col("region_state").alias("region")), tenants)
    text = F.concat(rc.strip_footer(F.col("answer")), F.coalesce("section", F.lit("")))
    more = routed.filter("response_type = 'more_sources'").select("query_id", "session_id", "language")
    new = sources.filter("NOT is_primary").join(routed.select("query_id", "session_id"), "query_id").select(
        "session_id", F.col("position").cast("int").alias("position"), "name", "score", "url")
    returned, kept = rc.pending_sources(new, more.select("session_id"), pending.select(*new.columns))
    responses = routed.join(answered, "query_id", "left").join(sections, "query_id", "left").join(_more_answer(more, returned), "query_id", "left").select(
        "query_id", "session_id", "language", "response_type", "status",
        F.when(F.col("response_type") == "recommendations", F.transform("_r", lambda r: r["tenant_id"])).alias("tenants"),
        F.when(F.col("response_type") == "recommendations", text).otherwise(F.col("more_answer")).alias("answer"))
    named = recommendations.join(routed.filter("response_type = 'recommendations'").select("query_id", "session_id"), "query_id")
    state = cs.focus_after(named.select("session_id", "tenant_id", F.col("name").alias("tenant_name")),
                           routed.select("session_id", "region_state", "focus_tenant", "focus_name"))
    last = named.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "tenant_id"))), lambda r: r["tenant_id"]).alias("tenants"))
    return Batch(responses, listing, kept, state.join(last, "session_id", "left"))


def _more_answer(requests: DataFrame, returned: DataFrame) -> DataFrame:
    """(query_id, more_answer): the sources held back for a session as a list."""
    line = F.concat(F.lit("- "), "name", F.lit(" ("), F.format_string("%.2f", F.col("score")), F.lit("): "), "url")
    lists = returned.groupBy("session_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("position", line.alias("l")))), lambda s: s["l"]), "\n").alias("_lines"))
    header = F.when(F.lower("language") == "en", "**Additional sources:**").otherwise("**Weitere Quellen:**")
    return requests.join(lists, "session_id").select("query_id", F.concat(header, F.lit("\n"), "_lines").alias("more_answer"))


def _gated(judged: DataFrame, relevant) -> DataFrame:
    """(query_id, context, fits): scores decide, the callable judges the undecided rows only."""
    decided = judged.filter("relevance = 'relevant'").select("query_id", "context", F.lit(True).alias("fits"))
    open_ = judged.filter("relevance <> 'relevant'")
    if relevant is None:
        return decided.unionByName(open_.select("query_id", "context", F.lit(True).alias("fits")))

    @F.pandas_udf("boolean")
    def fits(questions: pd.Series, contexts: pd.Series) -> pd.Series:
        return pd.Series([bool(x) for x in relevant(questions.tolist(), contexts.tolist())])

    return decided.unionByName(open_.select("query_id", "context", fits("text", "context").alias("fits")))


def _answer(rows: DataFrame, answer) -> DataFrame:
    key = dict(rows.dtypes)["query_id"]

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"query_id": batch["query_id"], "answer": answer(batch["text"].tolist(), batch["summary"].tolist(), batch["context"].tolist())})

    return rows.mapInPandas(run, f"query_id {key}, answer string")
