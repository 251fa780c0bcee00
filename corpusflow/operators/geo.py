"""Distance intents and ranking (GE)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import defaults as d
from corpusflow.functions.text import strip
from corpusflow.operators.retrieve import search
from corpusflow.operators.turns import has_strong_filter
from corpusflow.session import cut_lineage

TARGET = "struct<name:string,kind:string,place_kind:string,lat:double,lng:double>"
_ALIASES = [alias for place in d.PLACES for alias in place[4]]
_ANY_PLACE = r"(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(a) for a in sorted(_ALIASES, key=len, reverse=True)) \
    + r")(?![\p{L}\p{N}])"


# ---------------------------------------------------------------- distances

def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """GE1: great-circle distance, atan2 form."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng / 2) * F.sin(dlng / 2)
    return F.lit(2 * d.EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def resolve_coordinates(tenants: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """GE2: add lat, lng: the tenant's own valid pair, else the fallback(tenant_id, latitude, longitude)
    row, else dropped."""
    own = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    own = F.coalesce(own, F.lit(False))
    if fallback is None:
        return tenants.filter(own).withColumn("lat", F.col("latitude")).withColumn("lng", F.col("longitude"))
    other = fallback.select("tenant_id", F.col("latitude").alias("_flat"), F.col("longitude").alias("_flng"))
    joined = tenants.join(other, "tenant_id", "left")
    return joined.withColumn("lat", F.when(own, F.col("latitude")).otherwise(F.col("_flat"))) \
        .withColumn("lng", F.when(own, F.col("longitude")).otherwise(F.col("_flng"))) \
        .filter("lat IS NOT NULL AND lng IS NOT NULL").drop("_flat", "_flng")


def _place_literal(places) -> Column:
    """The gazetteer as one constant array<struct<name, place_kind, lat, lng>>."""
    rows = [{"name": p[0], "place_kind": p[1], "lat": p[2], "lng": p[3]} for p in places]
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), "array<struct<name:string,place_kind:string,lat:double,lng:double>>")


def nearest_place(lat: Column, lng: Column, kind: str = "SkiArea", places=d.PLACES) -> Column:
    """GE3: struct(km, name) of the nearest place of a kind; the gazetteer is a literal, no join."""
    options = _place_literal([p for p in places if p[1] == kind])
    return F.array_min(F.transform(options, lambda p: F.struct(
        haversine_km(lat, lng, p["lat"], p["lng"]).alias("km"), p["name"].alias("name"))))


# ---------------------------------------------------------------- intents

def _matches(text: Column, alternatives: list[str]) -> Column:
    return F.coalesce(F.lower(text).rlike(d.bounded(alternatives)), F.lit(False))


def _mentions_place(text: Column) -> Column:
    lower = F.lower(text)
    word, _, longer = d.CITY_WORD
    bare = lower.rlike(d.bounded([word]))
    for phrase in longer:
        bare = bare & ~F.contains(lower, F.lit(phrase))
    return F.coalesce(lower.rlike(_ANY_PLACE) | bare, F.lit(False))


def is_proximity(text: Column) -> Column:
    """A distance query: a proximity word together with a place or an unnamed ski area."""
    return _matches(text, d.PROXIMITY) & (_mentions_place(text) | _matches(text, d.UNNAMED_SKI_AREA))


# a pattern per place, in the order in which places claim their part of a text
_PLACE_PATTERNS = [(place[0], re.compile(r"(?<![^\W_])(?:" + "|".join(re.escape(a) for a in sorted(place[4], key=len, reverse=True)) + r")(?![^\W_])"))
                   for place in sorted(d.PLACES, key=lambda p: max(map(len, p[4])), reverse=True)]


def places_in(lower: str) -> list[str]:
    """GE4: place names in the order of their longest alias. What a place matches is blotted out for the places after it."""
    names, rest = [], lower
    for name, pattern in _PLACE_PATTERNS:
        rest, n = pattern.subn("\x01", rest)
        names += [name] * min(n, 1)
    word, city, longer = d.CITY_WORD
    whole = re.search(rf"\b{word}\b", lower) is not None and not any(phrase in lower for phrase in longer)
    return names + [city] * (whole and city not in names)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _places_udf(lower: pd.Series) -> pd.Series:
    return lower.map(lambda t: None if t is None else places_in(t))


def match_places(text: Column) -> Column:
    """GE4: names of the mentioned places; only texts that mention one travel to Python."""
    empty = F.array().cast("array<string>")
    return F.coalesce(_places_udf(F.when(_mentions_place(text), F.lower(strip(text)))), empty)


def parse_geo(queries: DataFrame, text: str = "text", other: str | None = None) -> DataFrame:
    """GE5: add targets, requires_lift, wants_nearest, conflicting, is_geo.

    The intent comes from ``text``, else from ``other`` (the search text).
    """
    def intent(df: DataFrame, column: str, suffix: str) -> DataFrame:
        t = F.col(column)
        df = df.withColumn(f"_near{suffix}", _matches(t, d.PROXIMITY)).withColumn(f"_lift{suffix}", _matches(t, d.LIFT_AT_DOOR)) \
            .withColumn(f"_area{suffix}", _matches(t, d.UNNAMED_SKI_AREA))
        return df.withColumn(f"_names{suffix}", match_places(F.when(F.col(f"_near{suffix}"), t)))

    parsed = intent(queries, text, "1")
    near, lift, area, names = (F.col(c) for c in ("_near1", "_lift1", "_area1", "_names1"))
    if other is not None:
        parsed = intent(parsed, other, "2")
        own = F.col("_near1") & ((F.size("_names1") > 0) | F.col("_area1"))
        near, lift, area = (F.when(own, F.col(f"_{n}1")).otherwise(F.col(f"_{n}2")) for n in ("near", "lift", "area"))
        names = F.when(own, F.col("_names1")).otherwise(F.col("_names2"))
    nearest = F.array(F.struct(F.lit(d.NEAREST_SKI).alias("name"), F.lit("NearestSkiArea").alias("kind"),
                               F.lit(None).cast("string").alias("place_kind"), F.lit(None).cast("double").alias("lat"),
                               F.lit(None).cast("double").alias("lng")))
    gazetteer = _place_literal(d.PLACES)
    named = F.transform(names, lambda n: F.element_at(F.filter(gazetteer, lambda p: p["name"] == n), 1))
    named = F.transform(named, lambda p: F.struct(p["name"].alias("name"), F.lit("Place").alias("kind"), p["place_kind"].alias("place_kind"),
                                                  p["lat"].alias("lat"), p["lng"].alias("lng"))).cast(f"array<{TARGET}>")
    parsed = parsed.withColumn("_named", named)
    named = F.col("_named")
    want = near & area & ~F.exists(named, lambda t: t["place_kind"] == "SkiArea")
    targets = F.when(want, F.concat(named, nearest.cast(f"array<{TARGET}>"))).when(near, named) \
        .otherwise(F.array().cast(f"array<{TARGET}>"))
    parsed = parsed.withColumn("targets", targets).withColumn("requires_lift", lift).withColumn("wants_nearest", want)
    places = F.size(F.filter("targets", lambda t: t["kind"] == "Place"))
    parsed = parsed.withColumn("conflicting", (places >= 2) | ((places >= 1) & (F.col("wants_nearest") | F.col("requires_lift"))))
    return parsed.withColumn("is_geo", F.size("targets") > 0).drop(*[c for c in parsed.columns if re.fullmatch(r"_(near|lift|area|names)\d|_named", c)])


def intent_key() -> Column:
    """Queries with the same targets and wishes share one ranking."""
    return F.concat_ws("|", F.array_join(F.transform("targets", lambda t: t["name"]), ";"), F.col("requires_lift").cast("string"))


# ---------------------------------------------------------------- ranking

def _km(target: Column, lat: Column, lng: Column) -> Column:
    return F.when(target["kind"] == "NearestSkiArea", nearest_place(lat, lng)["km"]) \
        .otherwise(haversine_km(lat, lng, target["lat"], target["lng"]))


def tenant_place_km(tenants: DataFrame) -> DataFrame:
    """(tenant columns, place, km) for every gazetteer place and the nearest ski area: a fixed factor."""
    named = F.transform(_place_literal(d.PLACES), lambda p: F.struct(
        p["name"].alias("place"), haversine_km(F.col("lat"), F.col("lng"), p["lat"], p["lng"]).alias("km"), (p["place_kind"] == "SkiArea").alias("ski")))
    every = tenants.withColumn("_named", named)
    nearest = F.struct(F.lit(d.NEAREST_SKI).alias("place"), F.array_min(F.transform(
        F.filter("_named", lambda p: p["ski"]), lambda p: p["km"])).alias("km"), F.lit(False).alias("ski"))
    return every.select("tenant_id", "has_lift", F.inline(F.concat("_named", F.array(nearest)))).drop("ski")


def _score(rows: DataFrame) -> DataFrame:
    """rows(subject, tenant_id, has_lift, pos, name, is_place, limit, km, requires_lift, conflicting) -> one row per tenant."""
    return rows.groupBy("subject", "tenant_id").agg(
        F.min("km").alias("primary_km"), F.first("has_lift").alias("has_lift"),
        F.sort_array(F.collect_list(F.struct("pos", "name", "km"))).alias("distances"),
        F.max(F.when(F.col("pos") == F.col("lead"), F.col("km"))).alias("_km1"),
        F.max(F.when(F.col("pos") == 1, F.col("km"))).alias("_km2"),
        (F.bool_and(F.col("km") <= F.col("limit")) & F.first(~F.col("requires_lift") | F.col("has_lift"))).alias("close_enough"),
        F.first("requires_lift").alias("requires_lift"), F.first("conflicting").alias("conflicting")) \
        .withColumn("_km1", F.coalesce("_km1", "primary_km"))


def _targets(subjects: DataFrame) -> DataFrame:
    """One row per target; ``lead`` is the first target that is a place, else the first."""
    lead = F.array_position(F.transform("targets", lambda t: t["kind"]), "Place")
    limit = F.when((F.col("t.place_kind") == "SkiArea") | (F.col("t.kind") == "NearestSkiArea"), d.CLOSE_SKI_KM).otherwise(d.CLOSE_CITY_KM)
    return subjects.withColumn("lead", F.greatest(lead - 1, F.lit(0)).cast("int")) \
        .select("subject", "lead", "requires_lift", "conflicting", F.posexplode("targets").alias("pos", "t")) \
        .select("subject", "lead", "requires_lift", "conflicting", "pos", "t", F.col("t.name").alias("name"), limit.alias("limit"))


def distance_scores(queries: DataFrame, tenants: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """GE6-GE8: (subject, tenant_id, primary_km, distances, has_lift, close_enough, ...).

    A subject is an intent, or the query itself when ``amenity_mixed`` restricts its candidates
    to tenants with text hits. Tenants are scored once per distinct intent, not once per query.
    """
    active = _located(tenants)
    geo = queries.filter("is_geo")
    columns = ["subject", "tenant_id", "has_lift", "pos", "name", "lead", "limit", "km", "requires_lift", "conflicting"]
    rows = _targets(_pure(geo)).join(tenant_place_km(active), F.col("name") == F.col("place")).select(*columns)
    if hits is not None:
        near = _targets(_mixed(geo)).join(_found(hits), "subject").join(active, "tenant_id") \
            .withColumn("km", _km(F.col("t"), F.col("lat"), F.col("lng"))).select(*columns)
        rows = rows.unionByName(near)
    return _score(rows)


def conflicts(scores: DataFrame) -> DataFrame:
    """GE9: subjects with conflicting wishes that no tenant satisfies."""
    return scores.groupBy("subject").agg((F.first("conflicting") & ~F.bool_or("close_enough")).alias("conflict"))


def _pure(geo: DataFrame) -> DataFrame:
    return geo.filter("NOT amenity_mixed").groupBy(F.col("intent").alias("subject")).agg(
        F.first("targets").alias("targets"), F.first("requires_lift").alias("requires_lift"), F.first("conflicting").alias("conflicting"))


def _located(tenants: DataFrame) -> DataFrame:
    return tenants.filter("is_active").select("tenant_id", F.coalesce("has_lift", F.lit(False)).alias("has_lift"), "lat", "lng")


def nearest_tenants(located: DataFrame, n: int) -> DataFrame:
    """(place, tenant_id): of each gazetteer place the ``n`` nearest tenants, and all that are as near as the nearest, with and
    without regard to a lift. Tasks keep a few rows per place before anything moves; places are a constant of the library."""
    every = tenant_place_km(located)
    place = Window.partitionBy("place")
    some = every.withColumn("r", F.row_number().over(place.orderBy("km", "tenant_id"))).filter(F.col("r") <= n)
    first = [rows.withColumn("r", F.rank().over(place.orderBy("km"))).filter(F.col("r") <= 1) for rows in (every, every.filter("has_lift"))]
    return some.unionByName(first[0]).unionByName(first[1]).select("place", "tenant_id").distinct()


def candidate_scores(geo: DataFrame, tenants: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """The rows of ``distance_scores`` that can be ranked or be a pole: a bounded number for each subject.

    The n tenants with the least distance to any target are among the n nearest of its targets, and the poles are nearest
    to one target. Queries whose candidates are restricted to tenants with text hits are scored for these.
    """
    located = _located(tenants)
    columns = ["subject", "tenant_id", "has_lift", "pos", "name", "lead", "limit", "km", "requires_lift", "conflicting"]
    pure = _targets(_pure(geo))
    near = nearest_tenants(located, n)
    wanted = pure.select("subject", "name").join(near, F.col("name") == F.col("place")).select("subject", "tenant_id").distinct()
    rows = [pure.join(wanted, "subject"), _targets(_mixed(geo)).join(_found(hits), "subject")]
    return _score(rows[0].unionByName(rows[1]).join(located, "tenant_id").withColumn("km", _km(F.col("t"), F.col("lat"), F.col("lng"))).select(*columns))


def _mixed(geo: DataFrame) -> DataFrame:
    return geo.filter("amenity_mixed").select(F.col("query_id").cast("string").alias("subject"), "targets", "requires_lift", "conflicting")


def _found(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("query_id").cast("string").alias("subject"), "tenant_id").distinct()


def verdicts(geo: DataFrame, tenants: DataFrame, scores: DataFrame) -> DataFrame:
    """GE9 without a row for each subject and tenant: (subject, conflict) of subjects with any candidate.

    A tenant matters only by the places that it is close to and its lift. Subjects of intents meet the distinct sets of
    places, through their first target; those restricted to text hits have all their candidates in ``scores``.
    """
    located = _located(tenants)
    named = F.transform(_place_literal(d.PLACES), lambda p: F.struct(
        p["name"].alias("place"), haversine_km(F.col("lat"), F.col("lng"), p["lat"], p["lng"]).alias("km"), (p["place_kind"] == "SkiArea").alias("ski")))
    with_km = located.withColumn("_named", named)
    close = F.transform(F.filter("_named", lambda p: p["km"] <= F.when(p["ski"], d.CLOSE_SKI_KM).otherwise(d.CLOSE_CITY_KM)), lambda p: p["place"])
    least_ski = F.array_min(F.transform(F.filter("_named", lambda p: p["ski"]), lambda p: p["km"]))
    close = F.concat(close, F.when(least_ski <= d.CLOSE_SKI_KM, F.array(F.lit(d.NEAREST_SKI))).otherwise(F.array().cast("array<string>")))
    sets = with_km.select("has_lift", close.alias("close")).distinct().select("has_lift", "close", F.explode("close").alias("place"))
    intents = _pure(geo).filter("conflicting").withColumn("names", F.transform("targets", lambda t: t["name"]))
    fits = F.size(F.array_except("names", "close")) == 0
    satisfied = intents.join(sets, F.get("names", F.lit(0)) == F.col("place")) \
        .filter(fits & (~F.col("requires_lift") | F.col("has_lift"))).select("subject").distinct().withColumn("_close", F.lit(True))
    mixed = conflicts(scores).join(_mixed(geo).select("subject"), "subject", "left_semi")
    pure = scores.join(_pure(geo).select("subject"), "subject", "left_semi").groupBy("subject").agg(F.first("conflicting").alias("conflicting")) \
        .join(satisfied, "subject", "left").select("subject", (F.col("conflicting") & F.col("_close").isNull()).alias("conflict"))
    return pure.unionByName(mixed)


def _branches(scores: DataFrame, verdict: DataFrame, n: int) -> DataFrame:
    """GE10: (subject, tenant_id, ord<source, ord>): poles first where there is a conflict, then by distance."""
    def best(name: str, condition: Column | None = None) -> Column:
        key = F.struct(F.col(name).alias("km"), F.col("primary_km").alias("p"), F.col("tenant_id"))
        return F.min(F.when(condition, key)) if condition is not None else F.min(key)

    lift = F.col("requires_lift") & F.col("has_lift")
    poles = scores.groupBy("subject").agg(best("_km1").alias("b1"), best("_km1", lift).alias("b2"),
                                          best("_km2", F.col("_km2").isNotNull()).alias("b3"))
    poles = poles.join(verdict.filter("conflict"), "subject").select("subject", F.inline(F.array(
        *[F.struct(F.col(f"b{i}.tenant_id").alias("tenant_id"), F.struct(F.lit(0).alias("source"), F.lit(i).alias("ord")).alias("ord")) for i in (1, 2, 3)]))) \
        .filter("tenant_id IS NOT NULL")
    window = Window.partitionBy("subject").orderBy("primary_km", "tenant_id")
    by_distance = scores.withColumn("ord", F.row_number().over(window)).filter(F.col("ord") <= n) \
        .select("subject", "tenant_id", F.struct(F.lit(1).alias("source"), "ord").alias("ord"))
    return poles.unionByName(by_distance)


def geo_rank(queries: DataFrame, tenants: DataFrame, hits: DataFrame, n: int = 3) -> DataFrame:
    """GE11: (query_id, tenant_id, geo_rank, primary_km, conflict, distances, has_lift).

    queries from ``prepare``; hits(query_id, tenant_id, text_rank) in text order. Queries without
    an intent or without candidates keep the text order; mixed ones are filled up from it. Of an intent only the tenants
    that can be ranked are scored, so nothing has a row for each intent and tenant.
    """
    queries = cut_lineage(queries.select("query_id", "targets", "requires_lift", "conflicting", "is_geo", "amenity_mixed", "intent"))
    geo = queries.filter("is_geo")
    scores = cut_lineage(candidate_scores(geo, tenants, hits, n))  # read three times below
    verdict = cut_lineage(verdicts(geo, tenants, scores))
    subject = F.when(F.col("amenity_mixed"), F.col("query_id").cast("string")).otherwise(F.col("intent"))
    asked = queries.select("query_id", "is_geo", "amenity_mixed", F.when(F.col("is_geo"), subject).alias("subject"))
    ordered = asked.join(_branches(scores, verdict, n), "subject").select("query_id", "tenant_id", "ord")
    known = verdict.select("subject", F.lit(True).alias("_scored"), "conflict")
    fill_for = asked.join(known, "subject", "left").filter("NOT is_geo OR amenity_mixed OR _scored IS NULL")
    filled = hits.select("query_id", "tenant_id", F.struct(F.lit(2).alias("source"), F.col("text_rank").cast("int").alias("ord")).alias("ord")) \
        .join(fill_for.select("query_id"), "query_id", "left_semi")
    best = ordered.unionByName(filled).groupBy("query_id", "tenant_id").agg(F.min("ord").alias("ord"))
    ranked = best.withColumn("geo_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("ord", "tenant_id"))) \
        .filter(F.col("geo_rank") <= n)
    detail = scores.select("subject", "tenant_id", "primary_km", "distances", "has_lift")
    return ranked.join(asked.select("query_id", "subject"), "query_id") \
        .join(verdict, "subject", "left").join(detail, ["subject", "tenant_id"], "left") \
        .select("query_id", "tenant_id", "geo_rank", "primary_km", F.coalesce("conflict", F.lit(False)).alias("conflict"), "distances", "has_lift")


def prepare(queries: DataFrame, text: str = "text") -> DataFrame:
    """Add the intent key and whether amenity filters restrict the candidates (ski words do not count
    when a lift at the door is wanted)."""
    return queries.withColumn("amenity_mixed", has_strong_filter(F.col(text), F.col("requires_lift"))) \
        .withColumn("intent", intent_key())


def backfill(ranked: DataFrame, hits: DataFrame, queries: DataFrame, chunks: DataFrame, tenants: DataFrame,
             n: int = 3, min_score: float = 0.20) -> DataFrame:
    """GE12: hits for ranked tenants that have none, by a search of their own; else a location row.

    -> (query_id, tenant_id, chunk_id, score, title, content, source_url); tenants carry lat and lng.
    """
    bare = ranked.join(hits.select("query_id", "tenant_id"), ["query_id", "tenant_id"], "left_anti").select("query_id", "tenant_id")
    asked = bare.join(queries.select("query_id", "embedding"), "query_id")
    more = search(asked, chunks, max(n, 3), min_score).select("query_id", "tenant_id", "chunk_id", "score") \
        .join(chunks.select("chunk_id", "title", "content", "source_url"), "chunk_id") \
        .withColumn("chunk_id", F.col("chunk_id").cast("string"))
    place = F.concat_ws(", ", *[F.when(F.trim(c) != "", F.col(c)) for c in ("name", "location", "region")])
    official = F.col("official_url") if "official_url" in tenants.columns else F.lit(None).cast("string")
    stub = bare.join(more.select("query_id", "tenant_id"), ["query_id", "tenant_id"], "left_anti").join(tenants, "tenant_id").select(
        "query_id", "tenant_id", F.concat(F.lit("geo-meta:"), "tenant_id").alias("chunk_id"), F.lit(0.0).alias("score"),
        F.lit("Location").alias("title"),
        F.format_string("%s. Coordinates WGS84 %.4f, %.4f.", place, F.col("lat"), F.col("lng")).alias("content"),
        F.coalesce(official, F.concat(F.lit("https://"), "domain")).alias("source_url"))
    return more.select(*stub.columns).unionByName(stub)


def briefing(ranked: DataFrame, queries: DataFrame, tenants: DataFrame) -> DataFrame:
    """GE13: (query_id, briefing): targets, wishes, conflict note, distances in rank order (n lines a query)."""
    lines = ranked.filter("distances IS NOT NULL").join(tenants.select("tenant_id", "name"), "tenant_id") \
        .withColumn("_line", F.concat(
            F.lit("  - "), "name", F.lit(": "),
            F.array_join(F.transform("distances", lambda t: F.concat(F.format_string("%.0f", t["km"]), F.lit(" km to "), t["name"])), "; "),
            F.lit("; lift at the door: "), F.when(F.col("has_lift"), "yes").otherwise("no")))
    body = lines.groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("geo_rank", "_line"))), lambda s: s["_line"]), "\n").alias("_lines"),
        F.bool_or("conflict").alias("conflict"))
    joined = queries.filter("is_geo").join(body, "query_id")
    return joined.select("query_id", F.concat_ws(
        "\n", F.lit("Distance constraints (they outrank text similarity):"),
        F.concat(F.lit("- Targets: "), F.array_join(F.transform("targets", lambda t: t["name"]), "; ")),
        F.when(F.col("requires_lift"), "- A ski lift directly at the door is required."),
        F.when(F.col("conflict"), "- Conflict: no tenant satisfies all distance wishes; name both poles."),
        F.lit("- Distances in rank order:"), F.col("_lines")).alias("briefing"))
