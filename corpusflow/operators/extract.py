"""Pages to chunks and links (EX)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.defaults import PLAIN_SELECTORS, RENDERED_SELECTORS, RESOURCE_SUFFIXES
from corpusflow.functions import text as tx
from corpusflow.functions.html import absolute_links, parse_page
from corpusflow.sources.tables import host_of

# Least length of a chunk, embedding batch size.
MIN_CONTENT = 50
EMBED_BATCH = 50
DEFAULT_LANGUAGE = "de"
PROFILES = {"plain": PLAIN_SELECTORS, "rendered": RENDERED_SELECTORS}


def is_resource(url: Column) -> Column:
    """EX1: the URL ends in a media, archive, office or asset suffix (a query string hides it)."""
    return url.rlike(r"(?i)\.(?:" + "|".join(RESOURCE_SUFFIXES) + r")$")


def parse_pages(pages: DataFrame, profile: str | list = "plain", keep: list[str] | None = None) -> DataFrame:
    """EX2-EX5: one pass over each page -> (keep columns, url, title, content, links).

    ``links`` are absolute http(s) URLs in page order. Title and content come back entity-decoded
    and cleaned (EX6); the cleaning itself runs as column expressions.
    """
    selectors = PROFILES[profile] if isinstance(profile, str) else list(profile)
    keep = keep or []
    types = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep),
                        "url string, title string, content string, links array<string>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            parsed = [parse_page(html, selectors) for html in batch["html"]]
            out = {c: batch[c].to_numpy() for c in keep}
            out["url"] = batch["url"].to_numpy()
            out["title"] = [p[0] for p in parsed]
            out["content"] = [p[1] for p in parsed]
            out["links"] = [absolute_links(u, p[2]) for u, p in zip(batch["url"], parsed)]
            yield pd.DataFrame(out)

    parsed = pages.filter(~is_resource(F.col("url"))).select(*keep, "url", "html").mapInPandas(run, schema)
    return parsed.select(*keep, "url", tx.clean(F.col("title")).alias("title"),
                         tx.clean(F.col("content")).alias("content"), "links")


def chunk_id(tenant: Column, url: Column) -> Column:
    """EX13: stable id, so that a re-crawl replaces its own rows."""
    return F.sha2(F.concat_ws("|", tenant, url), 256)


def chunks_of(parsed: DataFrame, tenant: Column | None = None, min_len: int = MIN_CONTENT,
              max_len: int | None = None, keep_len: int | None = None, crawled_at: Column | None = None) -> DataFrame:
    """EX7, EX8, EX13: pages with enough content as chunk rows; only ``max_len`` cuts a text (EX8)."""
    owner = tenant if tenant is not None else tenant_id_of(F.col("url"))
    fit = parsed.filter(F.length("content") >= min_len)
    content = F.col("content")
    if max_len is not None:
        content = tx.truncate_sentence(content, max_len, keep_len if keep_len is not None else max_len * 4 // 5)
    return fit.select(
        chunk_id(owner, F.col("url")).alias("chunk_id"), owner.alias("tenant_id"), F.col("url").alias("source_url"),
        "title", content.alias("content"),
        F.lit(DEFAULT_LANGUAGE).alias("language"), F.lit(True).alias("is_active"),
        (crawled_at if crawled_at is not None else F.lit(None).cast("timestamp")).alias("crawled_at"))


def extract_chunks(pages: DataFrame, profile: str | list = "plain", min_len: int = MIN_CONTENT,
                   max_len: int | None = None, model=None, known_languages: list[str] | None = None,
                   crawled_at: Column | None = None) -> DataFrame:
    """EX: pages(url, html[, tenant_id]) -> chunk rows. With a model the language is detected (EX9)."""
    keep = ["tenant_id"] if "tenant_id" in pages.columns else []
    tenant = F.col("tenant_id") if keep else None
    chunks = chunks_of(parse_pages(pages, profile, keep), tenant, min_len, max_len, crawled_at=crawled_at)
    return tag_language(chunks, model, known_languages) if model is not None else chunks


def tag_language(chunks: DataFrame, model, known: list[str] | None = None, sample_chars: int | None = None) -> DataFrame:
    """EX9: language of the text, or of its first ``sample_chars`` characters; ``de`` when blank or undecided."""
    from corpusflow.operators.textmodel import decide_language, detect_language

    text = F.col("content") if sample_chars is None else F.substring("content", 1, sample_chars)
    # the chunk itself is the key, so repeated and null ids stay rows of their own and nothing is joined
    rows = chunks.select(F.struct(*[c for c in chunks.columns if c != "language"]).alias("_chunk"), text.alias("text"))
    decided = detect_language(decide_language(rows, model, "_chunk"), known or model.labels, DEFAULT_LANGUAGE)
    return decided.select("_chunk.*", F.coalesce("language", F.lit(DEFAULT_LANGUAGE)).alias("language")).select(*chunks.columns)


def links_of(parsed: DataFrame, allowed: DataFrame | None = None, keep: list[str] | None = None,
             same_host: bool = True) -> DataFrame:
    """EX10: (keep, url, position, link): allowed hosts, no fragment, no resource, distinct per page.

    Without ``allowed(url_host, link_host)`` a link must stay on the page's own host, unless ``same_host`` is False.
    """
    keep = keep or []
    rows = parsed.select(*keep, "url", F.posexplode("links").alias("position", "link")) \
        .filter(~F.contains(F.col("link"), F.lit("#")) & ~is_resource(F.col("link")))
    if allowed is None:
        return rows.filter(host_of(F.col("link")) == host_of(F.col("url"))) if same_host else rows
    hosts = rows.withColumn("url_host", host_of(F.col("url"))).withColumn("link_host", host_of(F.col("link")))
    return hosts.join(allowed, ["url_host", "link_host"], "left_semi").drop("url_host", "link_host")


def extract_links(pages: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    keep = ["tenant_id"] if "tenant_id" in pages.columns else []
    return links_of(parse_pages(pages, "plain", keep), allowed, keep)


def base_host(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def tenant_id_of(url: Column) -> Column:
    return F.concat(F.lit("hotel_"), F.replace(base_host(url), F.lit("."), F.lit("_")))


def _title_case(name: Column) -> Column:
    """Upper-case the first letter of every run of letters (and digits), lower-case the rest."""
    pieces = F.regexp_extract_all(name, F.lit(r"([\p{L}\p{N}']+|[^\p{L}\p{N}']+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(p.substr(F.lit(2), F.length(p))))), "")


def derive_tenants(urls: DataFrame, url: str = "url", rendered: bool = False) -> DataFrame:
    """EX12: add tenant_id, name, domain and allowed_domains derived from the host."""
    host = base_host(F.col(url))
    raw = host
    for ending in (".at", ".com") if rendered else (".at", ".com", ".de"):
        raw = F.replace(raw, F.lit(ending), F.lit(""))
    return urls.withColumn("tenant_id", tenant_id_of(F.col(url))).withColumn("name", _title_case(raw)) \
        .withColumn("domain", host).withColumn("allowed_domains", F.array(host, F.concat(F.lit("www."), host)))


# ---------------------------------------------------------------- embedding

def feature_hash_embedder(dims: int = 64, seed: int = 7) -> Callable[[list[str]], np.ndarray]:
    """Offline stand-in for an embedding model: signed hashing of lower-cased words, unit length."""
    from xxhash import xxh64_intdigest as digest

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), dtype=np.float64)
        for row, text in enumerate(texts):
            h = np.array([digest(word, seed) for word in (text or "").lower().split()], dtype=np.uint64)
            signs = ((h >> np.uint64(32)) & np.uint64(1)).astype(np.float64) * 2 - 1
            out[row] = np.bincount((h % np.uint64(dims)).astype(np.int64), signs, dims)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(length > 0, length, 1.0)

    return embed


def embed_texts(df: DataFrame, text: str = "content", out: str = "embedding",
                embed: Callable[[list[str]], np.ndarray] | None = None, batch: int = EMBED_BATCH,
                max_len: int | None = None) -> DataFrame:
    """EX14: add vectors; whole texts, or texts cut at ``max_len`` (EX8), are passed on in batches of 50, row by row."""
    call = embed or feature_hash_embedder()
    whole = F.coalesce(F.col(text), F.lit(""))
    cut = df.withColumn("_cut", whole if max_len is None else tx.truncate_for_embedding(whole, max_len))

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.tolist()
            rows = [v for i in range(0, len(texts), batch) for v in np.asarray(call(texts[i:i + batch]), dtype=np.float32)]
            yield pd.Series(rows)

    return cut.withColumn(out, vectors("_cut")).drop("_cut")
