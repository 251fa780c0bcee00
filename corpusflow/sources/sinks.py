"""Upserts, patches, deletes and evolution as joins that yield the next table version (SNK)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import is_blank, strip


def last_per_key(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Last row per key of a batch; partial max_by keeps one row per key and task.

    Without an order, and among equal ones, a hash of the row decides, so the choice does not depend on the run.
    """
    values = [c for c in df.columns if c not in keys]
    tie = F.xxhash64(*[c for c, kind in df.dtypes if c in values and "map<" not in kind])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*([order] if order else []), tie.alias("_tie"))).alias("_v"))
    return picked.select(*keys, *[F.col(f"_v.`{c}`").alias(c) for c in values])


def _upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], update: dict[str, str],
            order: str | None = None) -> DataFrame:
    """Full outer join. ``update`` maps a column to "replace", "keep" or "coalesce" for known keys.

    Repeats inside the batch are resolved first: the largest ``order`` wins.
    """
    incoming = last_per_key(incoming, keys, order)
    old = existing.withColumn("_old", F.lit(True)).alias("o")
    new = incoming.withColumn("_new", F.lit(True)).alias("n")
    condition = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    joined = old.join(new, condition, "full_outer")
    return joined.select(*merged_columns(existing.columns, keys, update, set(incoming.columns), F.col("o._old").isNotNull(),
                                         F.col("n._new").isNotNull(), lambda c: F.col(f"o.`{c}`"), lambda c: F.col(f"n.`{c}`")))


def merged_columns(columns: list[str], keys: list[str], update: dict[str, str], given: set[str], is_old: Column, is_new: Column,
                   old: Callable[[str], Column], new: Callable[[str], Column]) -> list[Column]:
    """Columns of a row of the next version from its old and new form; a new row lacks columns that are not ``given``."""
    out = []
    for c in columns:
        if c in keys:
            out.append(F.coalesce(old(c), new(c)).alias(c))
            continue
        n = new(c) if c in given else F.lit(None)
        how = update.get(c, "keep")
        if how == "replace":
            out.append(F.when(is_new, n).otherwise(old(c)).alias(c))
        elif how == "coalesce":
            out.append(F.when(is_old, F.coalesce(n, old(c))).otherwise(n).alias(c))
        else:
            out.append(F.when(is_old, old(c)).otherwise(n).alias(c))
    return out


#: What a known chunk or session takes from a new one.
CHUNK_UPDATE = {"content": "replace", "title": "replace", "embedding": "replace", "crawled_at": "replace"}
SESSION_UPDATE = {"messages": "replace", "updated_at": "replace"}


def upsert_chunks(existing: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """SNK1: a known chunk_id gets new content, title, embedding and crawled_at only.

    Repeats inside the batch are resolved first: the largest ``order`` wins. ``store.merge_chunks`` does the same on a
    stored table and moves only what the batch touches.
    """
    return _upsert(existing, incoming, ["chunk_id"], CHUNK_UPDATE, order)


def tenant_update(columns: list[str]) -> dict[str, str]:
    update = {c: "replace" for c in columns if c not in ("tenant_id", "created_at")}
    return update | {c: "coalesce" for c in ("api_key", "latitude", "longitude")}


def tenant_rows(incoming: DataFrame, as_of: Column, strict_quirks: bool = True) -> DataFrame:
    if strict_quirks:
        incoming = incoming.withColumn("api_key", F.coalesce("api_key", F.lit("")))
    return incoming.withColumn("updated_at", as_of)


def upsert_tenants(existing: DataFrame, incoming: DataFrame, as_of: Column, strict_quirks: bool = True) -> DataFrame:
    """SNK2: replace all but api_key, latitude, longitude when the new value is null.

    The writer sends an empty text for a missing api key, which overwrites the old one;
    ``strict_quirks=False`` keeps the old key instead.
    """
    return _upsert(existing, tenant_rows(incoming, as_of, strict_quirks), ["tenant_id"], tenant_update(existing.columns))


def upsert_sessions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """SNK3: a known session gets new messages (and update time) only."""
    return _upsert(existing, incoming, ["session_id"], SESSION_UPDATE)


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """SNK4: (new table version, conflicting incoming rows)."""
    fresh = incoming.join(existing.select(*keys), keys, "left_anti")
    conflicts = incoming.join(existing.select(*keys), keys, "left_semi")
    return existing.unionByName(fresh, allowMissingColumns=True), conflicts


def null_if_blank(column: Column) -> Column:
    return F.when(~is_blank(column), strip(column))


def patch_tenants(tenants: DataFrame, patches: DataFrame) -> DataFrame:
    """SNK5: partial update. Non-blank name/domain and a non-empty domain list replace; other
    non-null values replace, blank text becomes null, blank categories are dropped."""
    joined = tenants.alias("t").join(patches.alias("p"), F.col("t.tenant_id") == F.col("p.tenant_id"), "left")
    columns = []
    for c in tenants.columns:
        t = F.col(f"t.{c}")
        if c == "tenant_id" or c not in patches.columns:
            columns.append(t.alias(c))
            continue
        p = F.col(f"p.{c}")
        if c in ("name", "domain"):
            columns.append(F.when(~is_blank(p), p).otherwise(t).alias(c))
        elif c == "allowed_domains":
            columns.append(F.when(F.size(p) > 0, p).otherwise(t).alias(c))
        elif c == "categories":
            columns.append(F.when(p.isNotNull(), F.filter(p, lambda x: ~is_blank(x))).otherwise(t).alias(c))
        elif c in ("location", "region", "country", "official_url", "source_url", "editorial_review_status"):
            columns.append(F.when(p.isNotNull(), null_if_blank(p)).otherwise(t).alias(c))
        else:
            columns.append(F.coalesce(p, t).alias(c))
    return joined.select(*columns)


def append_unless_present(df: DataFrame, additions: dict[str, tuple[str, str]], where: Column | None = None) -> DataFrame:
    """SNK6: per column (marker, fragment): append the fragment to texts that lack the marker.

    Columns are judged independently; ``_changed`` tells which rows differ.
    """
    scope = where if where is not None else F.lit(True)
    changed = F.lit(False)
    out = df
    for name, (marker, fragment) in additions.items():
        missing = F.coalesce(scope & F.col(name).isNotNull() & ~F.contains(F.col(name), F.lit(marker)), F.lit(False))
        changed = changed | missing
        out = out.withColumn(f"_n_{name}", F.when(missing, F.concat(F.col(name), F.lit(fragment))).otherwise(F.col(name)))
    out = out.withColumn("_changed", changed)
    return out.select(*[F.col(f"_n_{c}").alias(c) if c in additions else F.col(c) for c in df.columns], "_changed")


def overwrite_columns(df: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """SNK7: (updated table, change keys that do not exist)."""
    values = [c for c in changes.columns if c != key]
    joined = df.alias("d").join(changes.withColumn("_hit", F.lit(True)).alias("c"),
                                F.col(f"d.{key}") == F.col(f"c.{key}"), "left")
    out = joined.select(*[
        F.when(F.col("c._hit").isNotNull(), F.col(f"c.{c}")).otherwise(F.col(f"d.{c}")).alias(c)
        if c in values else F.col(f"d.{c}").alias(c) for c in df.columns])
    return out, changes.join(df.select(key), key, "left_anti")


def delete_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """SNK8: rows whose key is not listed (by tenant, id or session)."""
    return df.join(keys, on, "left_anti")


def expire_sessions(sessions: DataFrame, as_of: Column, max_age_hours: float = 24.0) -> DataFrame:
    """SNK9: drop sessions last updated before ``as_of`` minus the age."""
    limit = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(max_age_hours * 60)), F.lit(0.0))
    return sessions.filter(F.col("updated_at") >= limit)


def expire_jobs(jobs: DataFrame, as_of: Column, max_age_hours: int = 2) -> DataFrame:
    """SNK9: drop jobs that are not running and whose completion (else start) is too old."""
    limit = as_of - F.make_dt_interval(F.lit(0), F.lit(max_age_hours), F.lit(0), F.lit(0.0))
    done = F.col("status") != "running"
    return jobs.filter(~(done & (F.coalesce("completed_at", "started_at") < limit)))


def apply_feedback(existing: DataFrame, inserts: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """SNK10: validated inserts, text updates (name, keyword, text) and status updates by id."""
    changed = existing.alias("f").join(updates.withColumn("_hit", F.lit(True)).alias("u"),
                                       F.col("f.id") == F.col("u.id"), "left")
    hit = F.col("u._hit").isNotNull()
    columns = []
    for c in existing.columns:
        f = F.col(f"f.{c}")
        if c in ("name", "keyword", "text", "status") and c in updates.columns:
            columns.append(F.coalesce(F.col(f"u.{c}"), f).alias(c))
        elif c == "updated_at":
            columns.append(F.when(hit, as_of).otherwise(f).alias(c))
        else:
            columns.append(f.alias(c))
    return changed.select(*columns).unionByName(inserts, allowMissingColumns=True)


def enrich_by_id(df: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """SNK11: update listed columns of existing ids only; unknown ids are ignored."""
    return overwrite_columns(df, seed, key)[0]


def append_query_log(log: DataFrame, path: str) -> None:
    """SNK12: one row per checked query, partitioned by UTC day."""
    log.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def load_chunks(incoming: DataFrame, tenants: DataFrame, existing: DataFrame,
                order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """SNK13: (next chunk table, rejected rows of unknown tenants); language defaults to ``de``."""
    known, rejected = known_tenants(incoming, tenants)
    return upsert_chunks(existing, known, order), rejected


def known_tenants(incoming: DataFrame, tenants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of known tenants with a language, the others)."""
    known = incoming.join(tenants.select("tenant_id"), "tenant_id", "left_semi")
    rejected = incoming.join(tenants.select("tenant_id"), "tenant_id", "left_anti")
    known = known.withColumn("language", F.when(~is_blank(F.col("language")), F.col("language")).otherwise("de"))
    return known, rejected


def evolve(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """SNK14: add missing columns (name -> type); arrays start empty, the rest null."""
    for name, kind in columns.items():
        if name not in df.columns:
            value = F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)
            df = df.withColumn(name, value)
    return df


def snapshot(df: DataFrame, path: str) -> None:
    """SNK15: copy the table unless a copy exists."""
    df.write.mode("ignore").parquet(path)
