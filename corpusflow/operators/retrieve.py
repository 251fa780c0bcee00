"""Vector and keyword retrieval: filtered, grouped and approximate top-k (VS)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.vector import best_hits, cosine, topk_search, topk_stream, unit_matrix
from corpusflow.operators.product import SMALL_BYTES, SMALL_ROWS, measure, sliced_product, streamed_product
from corpusflow.session import cut_lineage

#: Vectors of the large side that meet the queries at once; each block of a task gives its best k of every query.
BLOCK_ROWS = 65_536
#: Queries of each core from which their blocks stay in the tasks and the chunks pass by; rows, bytes and hits of a block at most.
STREAM_ROWS, HELD_ROWS, HELD_BYTES, HELD_HITS = 128, 32_768, 32 * 1024 * 1024, 3_000_000

__all__ = ["cosine", "search", "search_all", "build_ivf", "search_ivf", "recall", "keyword_search",
           "followup_merge", "join_catalog", "chunk_counts", "existing_urls", "vectors_from_json",
           "vector_totals", "relevance_gate", "score_summary"]


def _rank(df: DataFrame, partition: list[str], order: list, k: int, name: str = "rn") -> DataFrame:
    window = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def stream_blocks(spark, rows: int, size: int, k: int) -> int:
    """Blocks of queries for ``streamed_product``, 0 if there are too few queries for it."""
    cores = spark.sparkContext.defaultParallelism
    if rows < STREAM_ROWS * cores:
        return 0
    return max(cores, -(-rows // max(1, min(HELD_ROWS, HELD_HITS // k))), -(-size // HELD_BYTES))


def _topk(queries: DataFrame, chunks: DataFrame, k: int, min_score: float, mode: str, group: str, max_rows: int, max_bytes: int,
          block_rows: int, per_group: int | None = None) -> tuple[DataFrame, bool]:
    """Hits among which are the k best of each query, and whether they are its ``per_group`` best of each group already."""
    id_type = dict(queries.dtypes)["query_id"]
    chunk_type, group_type = dict(chunks.dtypes)["chunk_id"], dict(chunks.dtypes)[group]
    big = chunks.filter(F.col("embedding").isNotNull()).select("chunk_id", F.col(group).alias("grp"), "embedding")
    schema = f"query_id {id_type}, chunk_id {chunk_type}, grp {group_type}, score double"
    if mode == "own":
        small = queries.select("query_id", F.col(group).alias("grp"), "embedding")
    else:
        small = cut_lineage(queries.select("query_id", "embedding"))  # measured, and read in blocks or slices
        blocks = stream_blocks(small.sparkSession, *measure(small), k)
        if blocks:
            # rows of one query count together, so only a query of one row can be cut where it is searched
            done = per_group is not None and small.groupBy("query_id").count().filter("count > 1 OR query_id IS NULL").isEmpty()
            hits = streamed_product(big, small, blocks, topk_stream(k, min_score, mode == "each", per_group if done else None), f"{schema}, rn int",
                                    ["grp", F.xxhash64("chunk_id")] if mode == "each" else None)
            return hits.withColumnRenamed("grp", group), done
        small = small.withColumn("grp", F.lit(None).cast(group_type))
    # the hits of a block are its best ones already; a task holds one block of rows, not the hits of all queries
    return sliced_product(big, small, topk_search(k, min_score, mode), schema, None, max_rows, max_bytes, block_rows).withColumnRenamed("grp", group), False


def search(queries: DataFrame, chunks: DataFrame, k: int = 5, min_score: float = 0.7,
           max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """VS2: best ``k`` active chunks of the query's own tenant.

    queries(query_id, tenant_id, embedding), chunks(chunk_id, tenant_id, embedding[, is_active])
    -> (query_id, tenant_id, chunk_id, score, rn). Each task keeps k rows per query before anything is shuffled.
    """
    if "is_active" in chunks.columns:
        chunks = chunks.filter("is_active")
    hits, _ = _topk(queries, chunks, k, min_score, "own", "tenant_id", max_rows, max_bytes, block_rows)
    return _rank(hits, ["query_id", "tenant_id"], [F.desc("score"), "chunk_id"], k) \
        .select("query_id", "tenant_id", "chunk_id", "score", "rn")


def search_all(queries: DataFrame, chunks: DataFrame, k: int = 5, min_score: float = 0.7,
               candidate_limit: int | None = None, refill: int = 20, tenants: DataFrame | None = None,
               max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """VS3: best ``k`` per tenant of each query, over all chunks.

    With a ``candidate_limit`` only the nearest chunks of each query are grouped, and up to ``refill`` active
    tenants without any hit (by id) are searched alone; ``tenants(tenant_id)`` lists them.
    """
    if "is_active" in chunks.columns:
        chunks = chunks.filter("is_active")
    order = [F.desc("score"), "chunk_id"]
    if candidate_limit is None:
        hits, done = _topk(queries, chunks, k, min_score, "each", "tenant_id", max_rows, max_bytes, block_rows, k)
        return (hits if done else _rank(hits, ["query_id", "tenant_id"], order, k)) \
            .select("query_id", "tenant_id", "chunk_id", "score", "rn")

    hits, done = _topk(queries, chunks, candidate_limit, min_score, "all", "tenant_id", max_rows, max_bytes, block_rows, k)
    if not done:
        near = _rank(hits, ["query_id"], order, candidate_limit, "_cand").drop("_cand")
        hits = _rank(near, ["query_id", "tenant_id"], order, k)
    if refill > 0 and tenants is not None:
        # A query has at most candidate_limit tenants with hits, so its first `refill` tenants
        # without hits lie among the first candidate_limit + refill ids: a bounded list.
        hits = cut_lineage(hits)  # read three times below
        first = [r["tenant_id"] for r in
                 tenants.select("tenant_id").distinct().orderBy("tenant_id")
                 .limit(candidate_limit + refill).collect()]
        tenant_type = dict(chunks.dtypes)["tenant_id"]
        listed = F.array(*[F.lit(t).cast(tenant_type) for t in first])
        found = hits.groupBy("query_id").agg(F.collect_set("tenant_id").alias("_found"))
        missing = (queries.select("query_id", "embedding").join(found, "query_id", "left")
                   .withColumn("_found", F.coalesce("_found", F.array().cast(f"array<{tenant_type}>")))
                   .select("query_id", "embedding",
                           F.explode(F.slice(F.array_except(listed, F.col("_found")), 1, refill)).alias("tenant_id")))
        hits = hits.unionByName(search(missing, chunks, k, min_score, max_rows, max_bytes, block_rows))
    return hits.select("query_id", "tenant_id", "chunk_id", "score", "rn")


def build_ivf(chunks: DataFrame, lists: int = 10, seed: int = 7):
    """VS4 (index): k-means lists over the chunk vectors -> (model, chunks with list_id)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = chunks.filter(F.col("embedding").isNotNull())
    # k-means reads its input once per iteration
    data = cut_lineage(usable.withColumn("_features", array_to_vector(F.col("embedding").cast("array<double>"))))
    model = KMeans(k=lists, seed=seed, distanceMeasure="cosine", featuresCol="_features",
                   predictionCol="list_id").fit(data)
    return model, model.transform(data).drop("_features")


def search_ivf(queries: DataFrame, model, indexed: DataFrame, k: int = 5, min_score: float = 0.7,
               nprobe: int = 3) -> DataFrame:
    """VS4: top-k among the ``nprobe`` lists nearest to the query; equal to a full search at nprobe = lists."""
    centres = np.stack([np.asarray(c, dtype=float) for c in model.clusterCenters()])
    unit, _ = unit_matrix(pd.Series(list(centres)))
    id_type = dict(queries.dtypes)["query_id"]

    def probe(batches):
        for batch in batches:
            batch = batch[batch["embedding"].notna()]
            if not len(batch):
                continue
            vectors, _ = unit_matrix(batch["embedding"])
            near = np.argsort(-(vectors @ unit.T), axis=1, kind="stable")[:, :nprobe]
            yield pd.DataFrame({
                "query_id": np.repeat(batch["query_id"].to_numpy(), near.shape[1]),
                "list_id": near.reshape(-1).astype("int32"),
                "embedding": np.repeat(batch["embedding"].to_numpy(), near.shape[1])})

    probes = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")) \
        .mapInPandas(probe, f"query_id {id_type}, list_id int, embedding array<double>")
    hits, _ = _topk(probes, indexed, k, min_score, "own", "list_id", SMALL_ROWS, SMALL_BYTES, BLOCK_ROWS)
    return _rank(hits, ["query_id"], [F.desc("score"), "chunk_id"], k).drop("list_id")


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of exact (query, chunk) hits that the approximate result also has."""
    both = approximate.select("query_id", "chunk_id").withColumn("_hit", F.lit(1))
    return exact.select("query_id", "chunk_id").join(both, ["query_id", "chunk_id"], "left") \
        .agg(F.count(F.lit(1)).alias("expected"), F.count("_hit").alias("found"),
             (F.count("_hit") / F.count(F.lit(1))).alias("recall"))


def _keyword_search(k: int, min_score: float, own: bool):
    """Terms are searched by one automaton a task and slice; a term's posting lists the queries that hold it, how often each.

    Scores are made for the queries in the postings of a text's terms only.
    """

    def prepare(small: pd.DataFrame):
        import ahocorasick

        wanted = [[t for t in str(q).lower().split(" ") if t] for q in small["query"].fillna("")]
        sizes = np.array([len(terms) for terms in wanted], dtype=np.float64)
        number = {t: i for i, t in enumerate(sorted({t for terms in wanted for t in terms}))}
        automaton = ahocorasick.Automaton()
        for term, i in number.items():
            automaton.add_word(term, i)
        if number:
            automaton.make_automaton()
        uses = np.array([(number[t], q) for q, terms in enumerate(wanted) for t in terms], dtype=np.int64).reshape(-1, 2)
        pair, times = np.unique(uses[:, 0] * len(small) + uses[:, 1], return_counts=True)
        asked = pair % max(1, len(small))
        first = np.searchsorted(pair, np.arange(len(number) + 1) * len(small))
        query_ids, query_groups = small["query_id"].to_numpy(), small["grp"].to_numpy()

        def postings(found: list[set[int]]) -> tuple[np.ndarray, np.ndarray]:
            """(row * queries + query, number of the query's terms in the row), for queries with any."""
            counts = np.fromiter(map(len, found), np.int64, len(found))
            rows = np.repeat(np.arange(len(found)), counts)
            terms = np.fromiter((t for some in found for t in some), np.int64, int(counts.sum()))
            length = first[terms + 1] - first[terms]
            at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first[terms], length)
            cells, place = np.unique(np.repeat(rows, length) * len(small) + asked[at], return_inverse=True)
            return cells, np.bincount(place, times[at], len(cells))

        def search(big: pd.DataFrame) -> pd.DataFrame:
            parts = []
            for start in range(0, len(big) if number else 0, 512):
                part = big.iloc[start:start + 512]
                titled = [{t for _, t in automaton.iter(str(x or "").lower())} for x in part["title"]]
                seen = [more | {t for _, t in automaton.iter(str(x or "").lower())} for x, more in zip(part["content"], titled)]
                cells, n = postings(seen)
                row, query = cells // len(small), cells % len(small)
                scores = np.minimum(1.0, n / sizes[query] + 0.2 * np.isin(cells, postings(titled)[0]))
                groups = part["grp"].to_numpy()[row]
                good = scores >= min_score
                if own:
                    good &= query_groups[query] == groups
                parts.append(pd.DataFrame({"query_id": query_ids[query[good]], "chunk_id": part["chunk_id"].to_numpy()[row[good]],
                                           "grp": groups[good], "score": scores[good]}))
            return pd.concat(parts) if parts else pd.DataFrame({"query_id": small["query_id"][:0], "chunk_id": big["chunk_id"][:0], "grp": big["grp"][:0],
                                                                "score": np.zeros(0)})

        return search

    return prepare


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int = 5, min_score: float = 0.7,
                   own_tenant: bool = False, max_rows: int = SMALL_ROWS) -> DataFrame:
    """VS5: share of the query's terms found in content or title, +0.2 for a title hit, at most 1.

    queries(query_id, query[, tenant_id]); chunks(chunk_id, tenant_id, content, title).
    A blank query has no hits. One tenant per query with ``own_tenant``, else every tenant.
    """
    if "is_active" in chunks.columns:
        chunks = chunks.filter("is_active")
    types = dict(chunks.dtypes)
    big = chunks.select("chunk_id", F.col("tenant_id").alias("grp"), "content", "title")
    group = F.col("tenant_id") if own_tenant else F.lit(None).cast(types["tenant_id"])
    small = queries.select("query_id", group.alias("grp"), "query")
    hits = sliced_product(
        big, small, _keyword_search(k, min_score, own_tenant),
        f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {types['chunk_id']}, "
        f"grp {types['tenant_id']}, score double",
        best_hits(k, ["query_id", "grp"]), max_rows).withColumnRenamed("grp", "tenant_id")
    return _rank(hits, ["query_id", "tenant_id"], [F.desc("score"), "chunk_id"], k)


def followup_merge(hits: DataFrame, state: DataFrame, queries: DataFrame, chunks: DataFrame,
                   k: int = 5, min_score: float = 0.7, limit: int = 3) -> DataFrame:
    """VS6: add hits of the focus and earlier recommended tenants unless already present.

    state(query_id, focus_tenant, recommended array); at most ``limit`` distinct tenants.
    """
    wanted = F.slice(F.array_distinct(F.filter(
        F.concat(F.array("focus_tenant"), F.coalesce("recommended", F.array())),
        lambda t: t.isNotNull())), 1, limit)
    asked = state.select("query_id", F.explode(wanted).alias("tenant_id")) \
        .join(queries.select("query_id", "embedding"), "query_id")
    extra = search(asked, chunks, k, min_score)
    extra = extra.join(hits.select("query_id", "tenant_id", "chunk_id"),
                       ["query_id", "tenant_id", "chunk_id"], "left_anti")
    columns = ["query_id", "tenant_id", "chunk_id", "score"]
    return hits.select(*columns).unionByName(extra.select(*columns))


def join_catalog(hits: DataFrame, tenants: DataFrame) -> DataFrame:
    """VS7: keep hits of known active tenants; Catalyst broadcasts the catalog when it is small."""
    return hits.join(tenants.filter("is_active"), "tenant_id")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """VS8: active chunks per tenant."""
    return chunks.filter("is_active").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("chunks"))


def existing_urls(chunks: DataFrame) -> DataFrame:
    """VS9: distinct active URLs per tenant, compared without case; the smallest spelling is shown."""
    return (chunks.filter("is_active").filter(F.trim("source_url") != "")
            .groupBy("tenant_id", F.lower("source_url").alias("url_key"))
            .agg(F.min("source_url").alias("source_url")).drop("url_key"))


def vectors_from_json(chunks: DataFrame, json_col: str = "embedding_json",
                      vector_col: str = "embedding") -> DataFrame:
    """VS10: fill missing vectors from their JSON text."""
    return chunks.withColumn(vector_col, F.coalesce(F.col(vector_col), F.from_json(json_col, "array<float>")))


def vector_totals(chunks: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """VS10: totals with and without a vector."""
    return chunks.agg(F.count(F.lit(1)).alias("total"), F.count(vector_col).alias("with_vector"),
                      (F.count(F.lit(1)) - F.count(vector_col)).alias("without_vector"))


def relevance_gate(queries: DataFrame, hits: DataFrame, threshold: float = 0.55) -> DataFrame:
    """VS11: best kept score >= threshold, or a distance-ranked query, is relevant; else undecided."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best_score"))
    ranked = F.col("is_geo") if "is_geo" in queries.columns else F.lit(False)
    return queries.join(best, "query_id", "left").withColumn(
        "relevance", F.when(ranked | (F.coalesce("best_score", F.lit(-1.0)) >= threshold), "relevant")
        .otherwise("undecided"))


def score_summary(hits: DataFrame, tenants: DataFrame) -> DataFrame:
    """VS12: best score per (query, tenant) with the tenant's name."""
    best = hits.groupBy("query_id", "tenant_id").agg(F.max("score").alias("score"))
    return best.join(tenants.select("tenant_id", "name"), "tenant_id")
