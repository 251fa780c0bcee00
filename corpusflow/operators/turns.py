"""Tags of single turns: region, named tenant, references, language choice (CT)."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import defaults as d
from corpusflow.functions.text import any_substring, is_blank, strip
from corpusflow.operators.product import SMALL_ROWS, sliced_product


def region_tag(text: Column, regions: list[tuple[str, list[str]]] = d.REGIONS) -> Column:
    """CT1: first region in list order with a word-bounded alias."""
    lower = F.lower(text)
    tag = None
    for name, aliases in regions:
        hit = lower.rlike(d.bounded(aliases))
        tag = F.when(hit, name) if tag is None else tag.when(hit, name)
    return tag


def is_deictic(text: Column) -> Column:
    return F.coalesce(text.rlike(d.bounded(d.DEICTIC)), F.lit(False))


def is_multi_tenant(text: Column) -> Column:
    return F.coalesce(text.rlike(d.bounded(d.MULTI_TENANT)), F.lit(False))


def is_more_sources(text: Column) -> Column:
    return F.coalesce(text.rlike(d.bounded(d.MORE_SOURCES)), F.lit(False))


def has_strong_filter(text: Column, ignore_ski: Column | bool = False) -> Column:
    """CT6: any strong filter word; ski words may be ignored."""
    lower = F.lower(strip(text))
    plain = any_substring(lower, [m for m in d.STRONG_FILTERS if m not in d.SKI_WORDS])
    ski = any_substring(lower, d.SKI_WORDS)
    keep = F.lit(not ignore_ski) if isinstance(ignore_ski, bool) else ~ignore_ski
    return F.coalesce(plain | (keep & ski), F.lit(False))


def is_broad_catalog(text: Column) -> Column:
    """CT5: a catalog question without strong filters that is no distance query."""
    from corpusflow.operators.geo import is_proximity

    return F.coalesce(F.lower(text).rlike(d.bounded(d.BROAD_CATALOG)) & ~has_strong_filter(text)
                      & ~is_proximity(text), F.lit(False))


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _bounded(text: str, start: int, end: int) -> bool:
    before = (start > 0 and _is_word(text[start - 1])) != _is_word(text[start])
    after = (end < len(text) and _is_word(text[end])) != _is_word(text[end - 1])
    return before and after


def _names(tenants: pd.DataFrame):
    """Two longest-named tenants that each text means: enough to see a unique longest one. The automaton is made once a task."""
    import ahocorasick

    patterns: dict[str, list[tuple[int, bool]]] = {}
    names = tenants["name"].tolist()
    for row, (tenant, name) in enumerate(zip(tenants["tenant_id"], names)):
        full = name.strip().lower()
        short = re.sub("hotel ", "", name.strip(), flags=re.IGNORECASE).strip().lower()
        patterns.setdefault(str(tenant).lower(), []).append((row, False))
        if len(full) >= 3:
            patterns.setdefault(full, []).append((row, False))
        if len(short) >= 4:
            patterns.setdefault(short, []).append((row, True))
    automaton = ahocorasick.Automaton()
    for pattern, uses in patterns.items():
        automaton.add_word(pattern, (len(pattern), uses))
    if patterns:
        automaton.make_automaton()

    sizes = np.array([len(n) for n in names], dtype="int32")

    def meant(lower: str) -> list[int]:
        found = set()
        for end, (size, uses) in automaton.iter(lower):
            found.update(row for row, whole in uses if not whole or _bounded(lower, end + 1 - size, end + 1))
        return sorted(found, key=lambda r: (-len(names[r]), r))[:2]

    def search(texts: pd.DataFrame) -> pd.DataFrame:
        lower = texts["text"].fillna("").str.strip().str.lower()
        long = lower.str.len() >= 3 if patterns else lower.str.len() < 0
        found = lower[long].map(meant)
        rows = np.array([r for some in found for r in some], dtype=np.int64)
        return pd.DataFrame({"text_id": texts["text_id"][long].repeat(found.map(len).to_numpy(np.int64)).to_numpy(),
                             "tenant_id": tenants["tenant_id"].to_numpy(dtype=object)[rows], "size": sizes[rows]})

    return search


def match_tenant(texts: DataFrame, tenants: DataFrame, key: str = "text_id", text: str = "text",
                 max_rows: int = SMALL_ROWS, block_rows: int = 8192) -> DataFrame:
    """CT2: (key, tenant_id, tenant_name) of the one tenant a text names; ties give no row.

    All names are searched in one pass over each text; no text meets a tenant it does not name.
    """
    known = tenants.filter("is_active").filter(~is_blank(F.col("name"))).select("tenant_id", "name")
    hits = sliced_product(
        texts.select(F.col(key).alias("text_id"), F.col(text).alias("text")), known, _names,
        f"text_id {dict(texts.dtypes)[key]}, tenant_id string, size int", max_rows=max_rows, block_rows=block_rows)
    best = hits.groupBy("text_id").agg(F.max(F.struct("size", "tenant_id")).alias("_a"),
                                       F.min(F.struct((-F.col("size")).alias("size"), F.col("tenant_id"))).alias("_b"))
    unique = best.filter(F.col("_a.tenant_id") == F.col("_b.tenant_id")) \
        .select(F.col("text_id").alias(key), F.col("_a.tenant_id").alias("tenant_id"))
    return unique.join(known.withColumnRenamed("name", "tenant_name"), "tenant_id").select(key, "tenant_id", "tenant_name")


# ---------------------------------------------------------------- language choice and vocabulary

def _letter_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(strip(text)), r"[^\p{L}]+"), lambda w: w != "")


def match_choice(text: Column, allowed: list[str] | None = None) -> Column:
    """CT8: a two-letter code, or the longest language name among the words (ties: list order)."""
    codes = set(allowed if allowed is not None else d.LANGUAGES)
    table, order = {}, 0
    for code, names in d.CHOICE_NAMES:
        for name in names:
            if code in codes:
                table.setdefault(name, {"size": -len(name), "order": order, "code": code})
            order += 1
    normal = F.regexp_replace(F.lower(strip(text)), r"\s+", " ")
    if not table:
        return F.when((F.length(normal) == 2) & normal.isin(*codes), normal)
    known = F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), "map<string,struct<size:int,order:int,code:string>>")
    named = F.array_min(F.filter(F.transform(_letter_words(text), lambda w: F.try_element_at(known, w)), lambda s: s.isNotNull()))
    return F.when((F.length(normal) == 2) & normal.isin(*codes), normal).otherwise(named["code"])


def is_affirmative(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(strip(text)), r"\s+", " ").isin(*d.AFFIRMATIVES), F.lit(False))


def has_german_marker(text: Column) -> Column:
    return F.coalesce(F.arrays_overlap(_letter_words(text), F.array(*[F.lit(w) for w in d.GERMAN_MARKERS])), F.lit(False))


def is_shared_vocabulary(text: Column) -> Column:
    """CT9: one to eight words, all shared between languages, at least one core word."""
    words = _letter_words(text)
    core = F.exists(words, lambda w: w.startswith("hotel") | w.isin("spa", "wellness", "sauna"))
    return F.coalesce(F.size(words).between(1, 8) & ~has_german_marker(text) & core
                      & F.forall(words, lambda w: w.isin(*d.SHARED_WORDS)), F.lit(False))


def has_policy_cue(text: Column) -> Column:
    return F.coalesce(any_substring(F.lower(text), d.POLICY_CUES), F.lit(False))


def close_languages(ranked: Column) -> Column:
    """CT10: candidates near the top of array<struct<code, p>>, at most four."""
    top = F.get(ranked, F.lit(0))["p"]
    near = F.filter(ranked, lambda r: (r["p"] >= d.MIN_CANDIDATE)
                    & ((top - r["p"] <= d.CLOSE_MARGIN) | (r["p"] >= top * d.CLOSE_RATIO)))
    return F.slice(near, 1, d.MAX_CLOSE)


def normal_hint(hint: Column) -> Column:
    code = F.substring(F.lower(F.trim(hint)), 1, 2)
    return F.when(code.isin(*d.LANGUAGES), code)


def language_features(turns: DataFrame, text: str = "text", ranked: str = "top", code: str = "code",
                      hint: str | None = None) -> DataFrame:
    """The columns one policy step needs, added to turns that carry a language decision (LG4)."""
    t, r = F.col(text), F.coalesce(F.col(ranked), F.array().cast("array<struct<code:string,p:double>>"))
    close = F.transform(close_languages(r), lambda s: s["code"])
    sticky = F.array_union(F.transform(F.filter(r, lambda s: s["p"] >= d.STICKY_MIN), lambda s: s["code"]), close)
    return turns.select(
        "*", has_german_marker(t).alias("marker"), is_shared_vocabulary(t).alias("shared"),
        has_policy_cue(t).alias("cue"), match_choice(t).alias("choice"), is_affirmative(t).alias("affirmative"),
        close.alias("close"), F.transform(sticky, lambda c: F.lower(c)).alias("sticky"),
        F.coalesce("is_unknown", F.lit(True)).alias("unknown"),
        F.coalesce("is_unrecognized_script", F.lit(False)).alias("unrecognized"),
        (normal_hint(F.col(hint)) if hint else F.lit(None).cast("string")).alias("_hint"))


def tag_turns(turns: DataFrame, tenants: DataFrame, text: str = "text",
              regions: list[tuple[str, list[str]]] = d.REGIONS) -> DataFrame:
    """CT1-CT7, CT9 as columns on turns(session_id, turn, text)."""
    t = F.col(text)
    keyed = turns.withColumn("_text_id", F.concat_ws(":", "session_id", "turn"))
    named = match_tenant(keyed, tenants, "_text_id", text)
    tagged = keyed.join(named.select("_text_id", F.col("tenant_id").alias("named_tenant"),
                                     F.col("tenant_name").alias("named_name")), "_text_id", "left").drop("_text_id")
    return tagged.select(
        "*", region_tag(t, regions).alias("region"), is_deictic(t).alias("deictic"), is_multi_tenant(t).alias("multi"),
        is_broad_catalog(t).alias("broad_catalog"), has_strong_filter(t).alias("strong_filter"),
        is_more_sources(t).alias("more_sources"), has_german_marker(t).alias("german_marker"),
        is_shared_vocabulary(t).alias("shared_vocabulary"))
