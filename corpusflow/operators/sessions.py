"""Per-session folds: language, region and focus, history, stored state (CS)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.policy import Summary, step
from corpusflow.functions.scan import SEGMENT, running_last
from corpusflow.functions.text import is_blank, strip
from corpusflow.operators.turns import is_deictic
from corpusflow.session import cut_lineage

FEATURES = ["text", "_hint", "marker", "shared", "cue", "choice", "affirmative", "close", "sticky", "code",
            "unknown", "unrecognized"]
HISTORY = 10


def _turn_of(values) -> dict:
    turn = dict(zip(FEATURES, values))
    turn["hint"] = turn.pop("_hint")
    turn["text"] = turn["text"] or ""
    turn["close"] = list(turn["close"]) if turn["close"] is not None else []
    turn["sticky"] = list(turn["sticky"]) if turn["sticky"] is not None else []
    return turn


def _summaries(batches):
    """Sorted (session, segment) runs -> one row with the effect of the run on every lock."""
    current, summary = None, None

    def row():
        ends = [(s, e[0], e[1]) for s, e in summary.end.items()]
        return [*current, [{"start": s, "lock": lock, "flag": flag} for s, lock, flag in ends]]

    for batch in batches:
        out = []
        keys = list(zip(batch["session_id"], batch["_seg"]))
        for key, values in zip(keys, zip(*[batch[c] for c in FEATURES])):
            if key != current:
                if current is not None:
                    out.append(row())
                current, summary = key, Summary()
            summary.add(_turn_of(values))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "_seg", "ends"])
    if current is not None:
        yield pd.DataFrame([row()], columns=["session_id", "_seg", "ends"])


def _chain(batches):
    """Sorted segment summaries of a session -> the lock each segment starts with."""
    session, lock, flag = None, None, False
    for batch in batches:
        starts = []
        for sid, ends, first_lock, first_flag in zip(batch["session_id"], batch["ends"], batch["_lock0"], batch["_flag0"]):
            if sid != session:
                session, lock, flag = sid, first_lock, bool(first_flag)
            starts.append([lock, flag])
            summary = Summary()
            summary.end = {e["start"]: (e["lock"], e["flag"]) for e in ends}
            lock, flag = summary.apply(lock, flag)
        yield pd.DataFrame({"session_id": batch["session_id"], "_seg": batch["_seg"],
                            "_lock": [s[0] for s in starts], "_flag": [s[1] for s in starts]})


def _fold(batches):
    current, state = None, None
    for batch in batches:
        out = []
        inputs = zip(batch["session_id"], batch["turn"], batch["_seg"], batch["_lock"], batch["_flag"],
                     batch["_pending_codes"], batch["_pending_query"], *[batch[c] for c in FEATURES])
        for sid, turn, seg, lock, flag, codes, query, *values in inputs:
            if (sid, seg) != current:
                current = (sid, seg)
                state = {"locked": lock, "first_unambiguous": bool(flag), "pending_codes": list(codes) if codes is not None else None,
                         "pending_query": query}
            state, language, source, text = step(state, _turn_of(values))
            out.append([sid, turn, language, source, text, state["locked"], bool(state["first_unambiguous"])])
        yield pd.DataFrame(out, columns=["session_id", "turn", "language", "source", "text_to_process", "locked",
                                         "first_unambiguous"])


def fold_language(features: DataFrame, initial: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """CS1: language, source and text per turn, in turn order per session.

    features come from ``turns.language_features`` (session_id, turn, ...). initial(session_id,
    locked, first_unambiguous, pending_codes, pending_query) holds states of earlier turns.
    Sessions longer than ``segment`` turns are cut: each piece is reduced to its effect on any
    incoming lock, the effects are chained, then all pieces fold in parallel.
    """
    types = dict(features.dtypes)
    # read several times below; the features are costly (language scores), the rows are small
    turns = cut_lineage(features.select("session_id", "turn", *FEATURES))
    first = turns.groupBy("session_id").agg(F.min("turn").alias("_first"))
    cut = turns.join(first, "session_id").withColumn("_seg", F.floor((F.col("turn") - F.col("_first")) / segment)).drop("_first")
    state = initial if initial is not None else None
    if state is not None:
        begin = state.select("session_id", F.col("locked").alias("_lock0"), F.col("first_unambiguous").alias("_flag0"),
                             F.col("pending_codes").alias("_codes0"), F.col("pending_query").alias("_query0"))
        cut = cut.join(begin, "session_id", "left")
    else:
        cut = cut.select("*", F.lit(None).cast("string").alias("_lock0"), F.lit(False).alias("_flag0"),
                         F.lit(None).cast("array<string>").alias("_codes0"), F.lit(None).cast("string").alias("_query0"))
    sid, turn_type = types["session_id"], types["turn"]
    long = cut.groupBy("session_id").agg(F.max("_seg").alias("_m")).filter("_m > 0").select("session_id")
    pieces = cut.join(long, "session_id", "left_semi")
    # A first turn with something pending is no function of the lock alone; it is folded on its own below.
    is_pending_turn = (F.col("_seg") == 0) & (F.size("_codes0") > 0)
    opening = None
    if state is not None:
        opening_rows = pieces.filter(is_pending_turn)
        first_turn = opening_rows.groupBy("session_id").agg(F.min_by(F.struct(*opening_rows.columns), "turn").alias("_r")) \
            .select("_r.*")
        opening = _run_fold(_with_start(first_turn), sid, turn_type).select(
            "session_id", F.col("turn").alias("_open_turn"), F.col("locked").alias("_lock1"), F.col("first_unambiguous").alias("_flag1"))
        pieces = pieces.join(opening, "session_id", "left") \
            .filter(F.col("_open_turn").isNull() | (F.col("turn") > F.col("_open_turn"))) \
            .withColumn("_lock0", F.when(F.col("_open_turn").isNotNull(), F.col("_lock1")).otherwise(F.col("_lock0"))) \
            .withColumn("_flag0", F.when(F.col("_open_turn").isNotNull(), F.col("_flag1")).otherwise(F.col("_flag0")))
    effects = pieces.repartition("session_id", "_seg").sortWithinPartitions("session_id", "_seg", "turn") \
        .select("session_id", "_seg", *FEATURES).mapInPandas(
            _summaries, f"session_id {sid}, _seg bigint, ends array<struct<start:string,lock:string,flag:boolean>>")
    begins = pieces.groupBy("session_id").agg(F.first("_lock0").alias("_lock0"), F.first("_flag0").alias("_flag0"))
    chained = effects.join(begins, "session_id").repartition("session_id").sortWithinPartitions("session_id", "_seg") \
        .mapInPandas(_chain, f"session_id {sid}, _seg bigint, _lock string, _flag boolean")
    started = cut.join(chained.filter("_seg > 0"), ["session_id", "_seg"], "left")
    head = F.col("_seg") == 0
    started = started.select(
        "session_id", "turn", "_seg", *FEATURES,
        F.when(head, F.col("_lock0")).otherwise(F.col("_lock")).alias("_lock"),
        F.coalesce(F.when(head, F.col("_flag0")).otherwise(F.col("_flag")), F.lit(False)).alias("_flag"),
        F.when(head, F.col("_codes0")).alias("_pending_codes"), F.when(head, F.col("_query0")).alias("_pending_query"))
    return _run_fold(started, sid, turn_type)


def _with_start(rows: DataFrame) -> DataFrame:
    return rows.select("session_id", "turn", "_seg", *FEATURES, F.col("_lock0").alias("_lock"),
                       F.coalesce("_flag0", F.lit(False)).alias("_flag"), F.col("_codes0").alias("_pending_codes"),
                       F.col("_query0").alias("_pending_query"))


def _run_fold(started: DataFrame, sid: str, turn_type: str) -> DataFrame:
    return started.repartition("session_id", "_seg").sortWithinPartitions("session_id", "_seg", "turn").mapInPandas(
        _fold, f"session_id {sid}, turn {turn_type}, language string, source string, text_to_process string, "
               "locked string, first_unambiguous boolean")


def fold_constraints(tagged: DataFrame, initial: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """CS2: region last mentioned and focus last set or cleared, as of each turn.

    tagged comes from ``turns.tag_turns``; initial(session_id, region, focus_tenant, focus_name).
    Adds region_state, focus_tenant, focus_name.
    """
    event = F.when(F.col("named_tenant").isNotNull(), F.struct(F.col("named_tenant").alias("t"), F.col("named_name").alias("n"))) \
        .when(F.col("multi") & ~F.col("deictic"), F.struct(F.lit(None).cast("string").alias("t"), F.lit(None).cast("string").alias("n")))
    marked = cut_lineage(tagged.withColumn("_event", event))
    run = running_last(marked, ["session_id"], "turn", {"region_state": "region", "_focus": "_event"}, segment=segment)
    if initial is not None:
        run = run.join(initial.select("session_id", F.col("region").alias("_r0"), F.col("focus_tenant").alias("_t0"),
                                      F.col("focus_name").alias("_n0")), "session_id", "left")
        run = run.withColumn("region_state", F.coalesce("region_state", "_r0")) \
            .withColumn("_focus", F.coalesce("_focus", F.struct(F.col("_t0").alias("t"), F.col("_n0").alias("n"))))
    return run.select(*tagged.columns, "region_state", F.col("_focus.t").alias("focus_tenant"), F.col("_focus.n").alias("focus_name"))


def _holds(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def enrich_query(text: Column, region: Column, focus: Column, focus_name: Column) -> Column:
    """CS3: focus name in front of a deictic query, region behind it unless already there."""
    q = strip(F.coalesce(text, F.lit("")))
    with_focus = ~is_blank(focus) & is_deictic(q)
    front = F.when(with_focus & ~is_blank(focus_name) & ~F.coalesce(_holds(q, focus_name), F.lit(False)), focus_name)
    joined = F.concat_ws(" ", front, F.when(q != "", q))
    add = ~is_blank(region) & ~with_focus & ~F.coalesce(_holds(joined, region), F.lit(False))
    return F.concat_ws(" ", F.when(joined != "", joined), F.when(add, region))


def matches_region(region: Column, prefix: str = "") -> Column:
    """Strict form: the region is part of the tenant's region, location, country, domain or id."""
    test = F.lit(False)
    for name in ("region", "location", "country", "domain", "tenant_id"):
        test = test | F.coalesce(_holds(F.col(prefix + name), F.trim(region)), F.lit(False))
    return is_blank(region) | test


def should_filter_region(text: Column, region: Column, focus: Column, focus_name: Column) -> Column:
    """CS4: a region is set and the turn does not speak of the focus tenant."""
    focused = ~is_blank(focus)
    named = focused & ~is_blank(focus_name) & F.coalesce(_holds(text, focus_name), F.lit(False))
    return ~is_blank(region) & ~(focused & is_deictic(text)) & ~named


def filter_hits_by_region(hits: DataFrame, queries: DataFrame, tenants: DataFrame) -> DataFrame:
    """CS4: drop hits outside the query's region; blank tenant regions and the focus tenant pass.

    queries(query_id, text, region_state, focus_tenant, focus_name, is_geo).
    """
    wanted = queries.select("query_id", F.col("region_state").alias("_region"), F.col("focus_tenant").alias("_focus"),
                            (should_filter_region(F.col("text"), F.col("region_state"), F.col("focus_tenant"), F.col("focus_name"))
                             & ~F.coalesce("is_geo", F.lit(False))).alias("_on"))
    info = tenants.select("tenant_id", "region", "location", "country", "domain")
    joined = hits.join(wanted, "query_id").join(info, "tenant_id")
    passes = ~F.col("_on") | is_blank(F.col("region")) | matches_region(F.col("_region")) \
        | F.coalesce(F.col("tenant_id") == F.col("_focus"), F.lit(False))
    return joined.filter(passes).select(*[hits[c] for c in hits.columns])


def recent_history(turns: DataFrame, n: int = HISTORY) -> DataFrame:
    """CS5: last n user/assistant turns per session; only n rows per session and task are shuffled on."""
    window = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return turns.filter(F.col("role").isin("user", "assistant")) \
        .withColumn("back", F.row_number().over(window)).filter(F.col("back") <= n)


def latest_state(records: DataFrame, schema: str, order: str = "ts") -> DataFrame:
    """CS6: newest payload per (session, kind), parsed; broken JSON gives null."""
    newest = records.groupBy("session_id", "kind").agg(F.max_by("payload", order).alias("payload"))
    return newest.withColumn("state", F.from_json("payload", schema))


def append_interactions(turns: DataFrame, interactions: DataFrame) -> DataFrame:
    """CS7: user turn, answer one ms later, recommended ids two ms later (when there are any).

    turns(session_id, role, content, ts); interactions(session_id, ts, question, answer, recommended).
    """
    def at(ms: int) -> Column:
        return F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ms / 1000.0))

    rows = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), at(0).alias("ts")),
        F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"), at(1).alias("ts")),
        F.struct(F.lit("system").alias("role"), F.when(F.size("recommended") > 0, F.to_json("recommended")).alias("content"), at(2).alias("ts")))
    new = interactions.select("session_id", F.inline(rows)).filter("content IS NOT NULL")
    return turns.select("session_id", "role", "content", "ts").unionByName(new)


def compact_state(records: DataFrame, order: str = "ts") -> DataFrame:
    """CS7: at most one record of each state kind per session."""
    others = [c for c in records.columns if c not in ("session_id", "kind")]
    newest = records.groupBy("session_id", "kind").agg(F.max_by(F.struct(*others), order).alias("_v"))
    return newest.select("session_id", "kind", *[F.col(f"_v.{c}").alias(c) for c in others])


def focus_after(recommended: DataFrame, state: DataFrame) -> DataFrame:
    """CS8: exactly one recommended tenant becomes the focus.

    recommended(session_id, tenant_id, tenant_name); state(session_id, focus_tenant, focus_name).
    """
    only = recommended.groupBy("session_id").agg(F.min(F.struct("tenant_id", "tenant_name")).alias("_a"),
                                                 F.max("tenant_id").alias("_z"))
    single = only.filter(F.col("_a.tenant_id") == F.col("_z")).select("session_id", "_a")
    return state.join(single, "session_id", "left").withColumn("focus_tenant", F.coalesce("_a.tenant_id", "focus_tenant")) \
        .withColumn("focus_name", F.coalesce("_a.tenant_name", "focus_name")).drop("_a")


def open_sessions(requests: DataFrame, sessions: DataFrame, as_of: Column) -> DataFrame:
    """CS9: (request_id, session_id, is_new, updated_at); unknown or blank ids get a new one."""
    known = sessions.select("session_id", F.lit(True).alias("_known"))
    fresh = F.sha2(F.concat_ws("|", F.lit("session"), F.col("request_id").cast("string")), 256)
    joined = requests.join(known, "session_id", "left")
    return joined.select("request_id", F.when(F.col("_known"), F.col("session_id")).otherwise(fresh).alias("session_id"),
                         F.col("_known").isNull().alias("is_new"), as_of.alias("updated_at"))

