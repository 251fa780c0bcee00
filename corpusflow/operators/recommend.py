"""Recommendation assembly: ranking, context, sources, catalog, routing (RC)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import defaults as d
from corpusflow.functions.text import is_blank, strip
from corpusflow.operators.product import sliced_product
from corpusflow.operators.retrieve import search, search_all

# Result and source limits, reason texts, joining rule line.
DEFAULT_RESULTS = 3
MAX_RESULTS = 20
MAX_URLS = 5
MAX_FEATURES = 5
SOURCES_PER_TENANT = 2
PRIMARY_SOURCES = 8
DETAIL_K = 8
DETAIL_MIN_SCORE = 0.40
CATALOG_K = 20
CATALOG_MIN_SCORE = 0.35
REASON_GEO = "Distance to requested location"
REASON_DEFAULT = "Matched from approved hotel content"
RULE = "\n\n---\n\n"


def _top(df: DataFrame, partition: list[str], order: list, n: int, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col(name) <= n)


def _first_distinct(hits: DataFrame, value: str, key: Column, n: int, out: str) -> DataFrame:
    """(query_id, tenant_id, out): first n distinct values in score order, one per key.

    The lists are cut to n by rank before they are collected, so no group grows with the data.
    """
    order = F.struct((-F.col("score")).alias("s"), F.col("chunk_id"))
    best = hits.filter(~is_blank(F.col(value))).groupBy("query_id", "tenant_id", key.alias("_key")) \
        .agg(F.min(order).alias("_o"), F.min_by(value, order).alias("_v"))
    ranked = _top(best, ["query_id", "tenant_id"], ["_o"], n)
    return ranked.groupBy("query_id", "tenant_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rn", "_v"))), lambda s: s["_v"]).alias(out))


def recommend(hits: DataFrame, tenants: DataFrame, geo: DataFrame | None = None, n: int = DEFAULT_RESULTS,
              max_urls: int = MAX_URLS, max_features: int = MAX_FEATURES) -> DataFrame:
    """RC1: per (query, tenant) best score, URLs, titles, reason, coordinates; ranked and cut.

    hits(query_id, tenant_id, chunk_id, score, title, source_url); geo(query_id, tenant_id,
    geo_rank, primary_km) decides the order of the queries it contains.
    """
    best = hits.groupBy("query_id", "tenant_id").agg(
        F.max("score").alias("match_score"),
        F.min_by("title", F.struct((-F.col("score")).alias("s"), F.col("chunk_id"))).alias("_best_title"))
    rows = best.join(tenants, "tenant_id")
    if geo is not None:
        rows = rows.join(geo.select("query_id", "tenant_id", "geo_rank", "primary_km"), ["query_id", "tenant_id"], "left") \
            .join(geo.filter("primary_km IS NOT NULL").select("query_id").distinct().withColumn("_is_geo", F.lit(True)), "query_id", "left")
    else:
        rows = rows.withColumn("geo_rank", F.lit(None).cast("int")).withColumn("primary_km", F.lit(None).cast("double")) \
            .withColumn("_is_geo", F.lit(None).cast("boolean"))
    is_geo = F.coalesce("_is_geo", F.lit(False))
    rows = rows.filter(~is_geo | F.col("geo_rank").isNotNull())
    ranked = _top(rows, ["query_id"], [F.when(is_geo, F.col("geo_rank")).asc_nulls_last(), F.desc("match_score"), "tenant_id"], n, "rank")
    keys = ranked.select("query_id", "tenant_id")
    kept = hits.join(keys, ["query_id", "tenant_id"], "left_semi")
    urls = _first_distinct(kept, "source_url", F.lower("source_url"), max_urls, "sources")
    titles = _first_distinct(kept, "title", F.col("title"), max_features, "features")
    reason = F.when(is_geo, REASON_GEO).when(~is_blank(F.col("_best_title")), F.col("_best_title")).otherwise(REASON_DEFAULT)
    has_point = "latitude" in tenants.columns
    lat = F.round("latitude", 6) if has_point else F.lit(None).cast("double")
    lng = F.round("longitude", 6) if has_point else F.lit(None).cast("double")
    empty = F.array().cast("array<string>")
    return ranked.withColumn("reason", reason).join(urls, ["query_id", "tenant_id"], "left") \
        .join(titles, ["query_id", "tenant_id"], "left").select(
        "query_id", "rank", "tenant_id", "name", F.col("match_score"), "reason", lat.alias("latitude"), lng.alias("longitude"),
        F.round("primary_km", 1).alias("distance_km"), F.coalesce("sources", empty).alias("sources"),
        F.coalesce("features", empty).alias("features"))


def result_count(value: Column) -> Column:
    """RC2: an integer of 1 to 20 from the configuration, else 3."""
    number = F.trim(value).try_cast("int")
    return F.when(number.between(1, MAX_RESULTS), number).otherwise(DEFAULT_RESULTS)


def assemble_context(hits: DataFrame, tenants: DataFrame, n: int = DEFAULT_RESULTS, briefing: DataFrame | None = None) -> DataFrame:
    """RC3: (query_id, context): the best 3n chunks as numbered blocks, the distance briefing in front."""
    kept = hits.join(tenants.select("tenant_id", "name"), "tenant_id")
    top = _top(kept, ["query_id"], [F.desc("score"), "chunk_id"], 3 * n)
    section = F.when(~is_blank(F.col("title")), F.concat(F.lit("Section: "), "title", F.lit("\n"))).otherwise("")
    block = F.concat(F.lit("[Result "), F.col("rn").cast("string"), F.lit("] HotelId: "), "tenant_id", F.lit(" | Hotel: "), "name", F.lit("\n"),
                     section, F.coalesce("content", F.lit("")), F.lit("\nSource URL: "), F.coalesce("source_url", F.lit("")))
    out = top.withColumn("_b", block).groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "_b"))), lambda s: s["_b"]), RULE).alias("context"))
    if briefing is None:
        return out
    return out.join(briefing, "query_id", "left").select("query_id", F.concat_ws("\n\n", "briefing", "context").alias("context"))


def _mentions(answer: Column, tenant: Column, name: Column) -> Column:
    lower, full = F.lower(answer), F.lower(name)
    short = F.trim(F.regexp_replace(name, "(?i)hotel ", ""))
    return F.coalesce(F.contains(lower, F.lower(tenant)) | (~is_blank(name) & F.contains(lower, full))
                      | ((F.length(short) >= 4) & F.contains(lower, F.lower(short))), F.lit(False))


def mentioned_tenants(answers: DataFrame, hits: DataFrame, tenants: DataFrame, fallback: int = 3) -> DataFrame:
    """RC4: (query_id, tenant_id): tenants of the query's hits that the answer names; without any, the best three."""
    found = hits.groupBy("query_id", "tenant_id").agg(F.max("score").alias("score")) \
        .join(tenants.select("tenant_id", "name"), "tenant_id").join(answers.select("query_id", "answer"), "query_id")
    query = Window.partitionBy("query_id")
    marked = found.withColumn("_named", _mentions(F.col("answer"), F.col("tenant_id"), F.col("name"))) \
        .withColumn("_any", F.max("_named").over(query)) \
        .withColumn("_rank", F.row_number().over(query.orderBy(F.desc("score"), "tenant_id")))
    return marked.filter(F.col("_named") | (~F.col("_any") & (F.col("_rank") <= fallback))).select("query_id", "tenant_id")


def weighted_sources(answers: DataFrame, hits: DataFrame, tenants: DataFrame, per_tenant: int = SOURCES_PER_TENANT,
                     primary: int = PRIMARY_SOURCES) -> DataFrame:
    """RC5: (query_id, tenant_id, name, url, score, position, is_primary) of the mentioned tenants."""
    mentioned = mentioned_tenants(answers, hits, tenants)
    url = F.trim("source_url")
    best = hits.join(mentioned, ["query_id", "tenant_id"], "left_semi").filter(~is_blank(F.col("source_url"))) \
        .groupBy("query_id", "tenant_id", F.lower(url).alias("_key")).agg(
        F.max("score").alias("score"), F.min_by(url, F.struct((-F.col("score")).alias("s"), F.col("chunk_id"))).alias("url"))
    two = _top(best, ["query_id", "tenant_id"], [F.desc("score"), "_key"], per_tenant, "_n").join(tenants.select("tenant_id", "name"), "tenant_id")
    # at most two rows per tenant of the query are left
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), F.lower("name"), "tenant_id", "_key")
    return two.withColumn("position", F.row_number().over(window)).select(
        "query_id", "tenant_id", "name", "url", "score", "position", (F.col("position") <= primary).alias("is_primary"))


def sources_section(sources: DataFrame, answers: DataFrame) -> DataFrame:
    """RC5: (query_id, section) in Markdown; answers(query_id, language)."""
    line = F.concat(F.lit("- "), "name", F.lit(" ("), F.format_string("%.2f", F.col("score")), F.lit("): "), "url")
    body = sources.groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("is_primary"), F.struct("position", line.alias("l"))))), lambda s: s["l"]), "\n").alias("_lines"),
        F.bool_or(~F.col("is_primary")).alias("_more"))
    english = F.lower("language") == "en"
    header = F.when(english, "\n\n---\n**Sources:**").otherwise("\n\n---\n**Quellen:**")
    more = F.when(english, "\n\nMore sources available — reply with “more sources”.") \
        .otherwise("\n\nWeitere Quellen verfügbar — antworten Sie mit „weitere Quellen“.")
    return answers.select("query_id", "language").join(body, "query_id").select(
        "query_id", F.concat(header, F.lit("\n"), "_lines", F.when(F.col("_more"), more).otherwise("")).alias("section"))


def strip_footer(answer: Column) -> Column:
    """RC6: remove the placeholder source block and white space at the end."""
    cleaned = F.regexp_replace(F.regexp_replace(answer, d.PLACEHOLDER_FOOTER, ""), r"\s+$", "")
    return F.when(is_blank(answer), F.coalesce(answer, F.lit(""))).otherwise(cleaned)


def pending_sources(sources: DataFrame, requests: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """RC7: (rows returned now, rows kept): a more-sources request returns and clears a session's rows.

    sources(session_id, …) are new additional rows; requests(session_id) asked for more.
    """
    returned = pending.join(requests.select("session_id"), "session_id", "left_semi")
    kept = pending.join(requests.select("session_id"), "session_id", "left_anti") \
        .join(sources.select("session_id"), "session_id", "left_anti").unionByName(sources)
    return returned, kept


def catalog(queries: DataFrame, tenants: DataFrame, chunks: DataFrame | None = None, seed: int = 7) -> DataFrame:
    """RC8: (query_id, position, tenant_id, line) for catalog questions: ``catalog_lists`` with its parts joined."""
    listed, links = catalog_lists(queries, tenants, chunks, seed)
    return links.join(listed, "region").select("query_id", "position", "tenant_id", "line")


def catalog_lists(queries: DataFrame, tenants: DataFrame, chunks: DataFrame | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """RC8, normalised: (region, position, tenant_id, line) of each distinct region asked for, and (query_id, region).

    queries(query_id, region[, embedding]). A listing belongs to the region, not to the query, so its rows do not grow with
    the questions; a blank region lists all active tenants. ``embedding`` is the vector of the region text; its hits add
    tenants whose region and location are blank.
    """
    active = tenants.filter("is_active")
    wanted = queries.select(F.coalesce("region", F.lit("")).alias("_region")).distinct()
    by_value = _regions_of(active, wanted)
    if chunks is not None:
        probe = queries.filter(~is_blank(F.col("region"))).groupBy("region").agg(F.first("embedding").alias("embedding")) \
            .select(F.col("region").alias("query_id"), "embedding")
        hits = search_all(probe, chunks, CATALOG_K, CATALOG_MIN_SCORE, tenants=active)
        bare = active.filter(is_blank(F.col("region")) & is_blank(F.col("location"))).select("tenant_id")
        extra = hits.select(F.col("query_id").alias("_region"), "tenant_id").distinct().join(bare, "tenant_id", "left_semi")
        by_value = by_value.unionByName(extra.select("_region", "tenant_id")).dropDuplicates(["_region", "tenant_id"])
    place = F.concat_ws(", ", *[F.when(~is_blank(F.col(c)), F.col(c)) for c in ("location", "region")])
    shuffled = by_value.join(active, "tenant_id").withColumn("_h", F.xxhash64(F.lit(seed), "_region", "tenant_id"))
    numbered = _number(shuffled)
    line = F.concat(F.col("position").cast("string"), F.lit(". "), "name", F.when(place != "", F.concat(F.lit(" — "), place)).otherwise(""),
                    F.lit(" (id: "), "tenant_id", F.lit(")"))
    listed = numbered.select(F.col("_region").alias("region"), "position", "tenant_id", line.alias("line"))
    return listed, queries.select("query_id", F.coalesce("region", F.lit("")).alias("region"))


def _number(shuffled: DataFrame) -> DataFrame:
    """Position in hash order inside a region, in two levels: hash ranges, then rows of a range."""
    cut = shuffled.withColumn("_bucket", F.shiftright("_h", 58).cast("int"))
    sizes = cut.groupBy("_region", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_region").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("_region", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_region", "_bucket").orderBy("_h", "tenant_id")
    return cut.join(offset, ["_region", "_bucket"]).withColumn("position", F.row_number().over(inner) + F.col("_before"))


def _region_search(regions: pd.DataFrame):
    """Tenants whose fields hold a region's text; the empty text is in all."""
    import ahocorasick

    automaton, everywhere = ahocorasick.Automaton(), []
    for region in regions["_region"]:
        word = region.strip().lower()
        if word:
            automaton.add_word(word, [*automaton.get(word, []), region])
        else:
            everywhere.append(region)
    if len(automaton):
        automaton.make_automaton()

    def search(tenants: pd.DataFrame) -> pd.DataFrame:
        found = [sorted({r for _, some in (automaton.iter(fields) if len(automaton) else ()) for r in some}) + everywhere for fields in tenants["_fields"]]
        return pd.DataFrame({"_region": pd.Series([r for some in found for r in some], dtype=object),
                             "tenant_id": tenants["tenant_id"].to_numpy(dtype=object).repeat([len(some) for some in found])})

    return search


def _regions_of(tenants: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_region, tenant_id): the strict region test of each distinct region asked for."""
    fields = F.concat_ws("\u0001", *[F.lower(c) for c in ("region", "location", "country", "domain", "tenant_id")])
    return sliced_product(tenants.select("tenant_id", fields.alias("_fields")), wanted, _region_search, "_region string, tenant_id string")


def route(queries: DataFrame) -> DataFrame:
    """RC9: add response_type and status.

    Columns: needs_clarification, ethical, in_scope, more_sources, has_pending, broad_catalog, n_hits.
    """
    kind = F.when(F.col("needs_clarification"), "language_clarification").when(~F.col("ethical"), "ethical_reject") \
        .when(~F.col("in_scope"), "out_of_scope").when(F.col("more_sources") & F.col("has_pending"), "more_sources") \
        .when(F.col("broad_catalog"), "catalog").when(F.col("n_hits") == 0, "no_results").otherwise("recommendations")
    return queries.withColumn("response_type", kind).withColumn("status", status_of(kind))


def status_of(response_type: Column) -> Column:
    """RC10: ok, no_match or error."""
    return F.when(response_type.isin("no_results", "out_of_scope", "no_match", "ethical_reject", "no_data"), "no_match") \
        .when(response_type == "error", "error").otherwise("ok")


def compose_query() -> Column:
    """RC11: filters as one query text; missing and blank parts are left out."""
    def text(name: str) -> Column:
        return F.when(~is_blank(F.col(name)), strip(F.col(name)))

    adults, dogs = F.col("adults_only"), F.col("dogs_allowed")
    return F.concat_ws(
        " ", text("message"), text("region"), text("wellness_focus"), text("travel_dates"), F.col("guests").cast("string"),
        F.when(adults, "adults only").when(~adults, "family"), text("budget"), F.when(dogs, "dogs").when(~dogs, "no dogs"))


def public_view(tenants: DataFrame) -> DataFrame:
    """RC12: display form: blanks become "not available", only valid coordinates, dates as yyyy-MM-dd."""
    def shown(column: Column) -> Column:
        return F.when(is_blank(column), d.NOT_AVAILABLE).otherwise(strip(column))

    point = F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.lit(False))
    columns = [F.col("tenant_id"), F.col("name")]
    columns += [shown(F.col(c)).alias(c) for c in ("location", "region", "country")]
    columns += [F.when(point, F.col(c)).alias(c) for c in ("latitude", "longitude")]
    columns.append(shown(official_url(F.col("official_url"), F.col("domain"))).alias("official_url"))
    columns += [shown(F.col(c)).alias(c) for c in ("source_url", "editorial_review_status")]
    columns.append(F.date_format("editorial_reviewed_at", "yyyy-MM-dd").alias("editorial_reviewed_at"))
    columns.append(F.coalesce(F.filter("categories", lambda x: ~is_blank(x)), F.array().cast("array<string>")).alias("categories"))
    return tenants.select(*columns)


def official_url(url: Column, domain: Column) -> Column:
    host = strip(domain)
    return F.when(~is_blank(url), strip(url)).when(is_blank(domain), F.lit(None)) \
        .when(host.rlike("(?i)^https?://"), host).otherwise(F.concat(F.lit("https://"), host))


def append_sources(answer: Column, lines: Column) -> Column:
    """RC13: append the source lines (array of string) unless a source block with a URL is there."""
    present = F.coalesce(answer.rlike(d.SOURCE_BLOCK), F.lit(False))
    return F.when(present | (F.coalesce(F.size(lines), F.lit(0)) <= 0), answer) \
        .otherwise(F.concat(answer, F.lit("\n\n---\n**Quellen:**\n"), F.array_join(lines, "\n")))


def tenant_detail(queries: DataFrame, chunks: DataFrame, tenants: DataFrame, k: int = DETAIL_K,
                  min_score: float = DETAIL_MIN_SCORE) -> DataFrame:
    """RC14: (query_id, tenant_id, response_type, confidence, sources, context) for one known active tenant per query."""
    known = tenants.filter("is_active").select("tenant_id", "name")
    asked = queries.join(known, "tenant_id", "left")
    hits = search(asked.filter("name IS NOT NULL"), chunks, k, min_score).drop("rn") \
        .join(chunks.select("chunk_id", "title", "content", "source_url"), "chunk_id")
    summary = hits.groupBy("query_id").agg(F.max("score").alias("confidence"))
    urls = _first_distinct(hits, "source_url", F.col("source_url"), k, "sources").select("query_id", "sources")
    context = assemble_context(hits, tenants, k)
    out = asked.select("query_id", "tenant_id", "name").join(summary, "query_id", "left").join(urls, "query_id", "left").join(context, "query_id", "left")
    kind = F.when(F.col("name").isNull(), "error").when(F.col("confidence").isNull(), "no_data").otherwise("detail")
    return out.select("query_id", "tenant_id", kind.alias("response_type"), "confidence",
                      F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "context")
