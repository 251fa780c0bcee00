"""Ingest, rate limits and live step durations as streams (ST2-ST4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusflow.operators.extract import extract_chunks, tenant_id_of
from corpusflow.session import cut_lineage
from corpusflow.sources.store import BUCKET, bucket_of, touched_buckets
from corpusflow.streaming.state import TIME, restart_timer, stateful

# Request limits per client.
PER_MINUTE = 60
PER_HOUR = 1000


#: Hash partitions of the known keys of an ingested table.
KEY_BUCKETS = 64


def _known_keys(spark: SparkSession, path: str, keys: DataFrame, batch_id: int) -> DataFrame:
    """Keys (tenant_id, _key) of the log that stand in the buckets of a batch's ``keys`` and came with earlier batches."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    types = dict(keys.dtypes)
    schema = f"tenant_id {types['tenant_id']}, _key string, batch_id long, {BUCKET} int"
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(F.col(BUCKET).isin(touched_buckets(keys)) & (F.col("batch_id") < batch_id))


def ingest_batch(pages: DataFrame, batch_id: int, path: str, **options) -> None:
    """ST2, one micro-batch: extract, drop known URLs, write the new chunks to the batch's partition.

    A repeated batch overwrites its own partitions only, and ids are stable (EX13), so a retry changes nothing. The table
    is never rewritten. Known URLs are looked up before any page is parsed, in a log of keys below ``path``/_keys that is
    partitioned by a hash of the key: a batch reads the buckets of its own keys, as earlier batches left them. The log is
    written after the chunks, from these. Of a page that a tenant repeats in a batch the greatest text counts.
    """
    spark = pages.sparkSession
    if "tenant_id" not in pages.columns:
        pages = pages.withColumn("tenant_id", tenant_id_of(F.col("url")))
    once = pages.groupBy("tenant_id", "url").agg(F.max("html").alias("html")).withColumn("_key", F.lower("url"))
    bucket = bucket_of(["tenant_id", "_key"], KEY_BUCKETS)
    log = f"{path}/_keys"
    known = _known_keys(spark, log, cut_lineage(once.select("tenant_id", "_key", bucket).distinct()), batch_id)
    fresh = once.join(known.select("tenant_id", "_key"), ["tenant_id", "_key"], "left_anti").drop("_key")
    part = f"{path}/batch_id={batch_id}"
    extracted = extract_chunks(fresh, **options)
    extracted.write.mode("overwrite").parquet(part)
    written = spark.read.schema(extracted.schema).parquet(part).where("is_active")
    written.select("tenant_id", F.lower("source_url").alias("_key")).distinct().withColumn(BUCKET, bucket).repartition(BUCKET) \
        .write.mode("overwrite").partitionBy(BUCKET).parquet(f"{log}/batch_id={batch_id}")


def ingest_stream(pages: DataFrame, path: str, checkpoint: str, **options):
    """ST2: start the ingest of a stream of pages(url, html[, tenant_id]) and return the query."""
    return pages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True) \
        .foreachBatch(lambda batch, number: ingest_batch(batch, number, path, **options)).start()


def rate_violations(events: DataFrame, client: str = "user_id", ts: str = "ts", window: str = "1 minute",
                    limit: int = PER_MINUTE, watermark: str | None = None) -> DataFrame:
    """ST3: clients with more than ``limit`` requests in a tumbling window; batch or, with a watermark, stream."""
    if watermark is not None:
        events = events.withWatermark(ts, watermark)
    counted = events.groupBy(F.window(ts, window), client).agg(F.count(F.lit(1)).alias("requests"))
    return counted.filter(F.col("requests") > limit).select(
        client, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "requests")


OPEN = "done long, starts array<long>, ends array<struct<elapsed_ms:long,duration_ms:long,kind:string,status:string>>"
DURATIONS = "run_id string, agent string, occurrence bigint, kind string, duration_ms bigint, status string"


class PairSteps(StatefulProcessor):
    """First-in-first-out pairing of starts and ends per (run, agent); the open ones and the number of pairs are one value state.

    Each call to the state store is a round trip, and most keys have few steps: a batch reads a key's state once and writes it
    once, if it has changed. With a time to live a timer forgets what is open, counted from the last step.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, starts, ends = self.open.get() or (0, [], [])
        starts, ends = list(starts), [tuple(e) for e in ends]
        for part in rows:
            for phase, ms, given, kind, status in zip(*(part[c].tolist() for c in ("phase", "elapsed_ms", "duration_ms", "kind", "status"))):
                if phase == "start":
                    starts.append(int(ms))
                else:
                    ends.append((int(ms), None if pd.isna(given) else int(given), kind, status))
            restart_timer(self.handle, part, self.ttl_ms)
        starts.sort()
        ends.sort(key=lambda e: e[0])
        pairs = min(len(starts), len(ends))
        self.open.update((done + pairs, starts[pairs:], ends[pairs:]))
        if pairs:
            yield pd.DataFrame([(key[0], key[1], done + i + 1, kind, given if given is not None else end - begun, status)
                                for i, (begun, (end, given, kind, status)) in enumerate(zip(starts[:pairs], ends))], columns=_DURATIONS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


_DURATIONS = [c.split()[0] for c in DURATIONS.split(", ")]

#: Hash buckets of (run, agent) whose state is one value; fixed for a checkpoint.
STEP_BUCKETS = 512
_OPEN = pa.schema([("run_id", pa.string()), ("agent", pa.string()), ("start", pa.bool_()), ("elapsed_ms", pa.int64()),
                   ("duration_ms", pa.float64()), ("kind", pa.string()), ("status", pa.string())])
_KEYS = pa.schema([("run_id", pa.string()), ("agent", pa.string()), ("done", pa.int64()), ("due", pa.int64())])


def _stored(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_pandas(rows, schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _read(data: bytes | None, schema: pa.Schema) -> pd.DataFrame:
    return (pa.ipc.open_stream(bytes(data)).read_all() if data else schema.empty_table()).to_pandas()


def _key_codes(*frames: pd.DataFrame) -> list[np.ndarray]:
    """Numbers of the (run_id, agent) of some frames, the same for the same pair; null is a value."""
    runs, names = pd.factorize(np.concatenate([f["run_id"].to_numpy(object) for f in frames]), use_na_sentinel=False)
    agents, _ = pd.factorize(np.concatenate([f["agent"].to_numpy(object) for f in frames]), use_na_sentinel=False)
    codes = pd.factorize(agents.astype(np.int64) * (len(names) + 1) + runs)[0]
    return np.split(codes, np.cumsum([len(f) for f in frames])[:-1])


def _ranks(codes: np.ndarray, ms: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key and time, place of each in its key, rows of each key); rows of one time keep their order."""
    order = np.lexsort((ms, codes))
    counts = np.bincount(codes, minlength=n)
    return order, np.arange(len(order)) - (np.cumsum(counts) - counts)[codes[order]], counts


class PairBuckets(StatefulProcessor):
    """``PairSteps`` for the keys (run, agent) of a bucket together: open steps, numbers of pairs and due times are one value.

    A call and its state cost the same for a thousand keys as for one. One timer a bucket stands at its first due time.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("bucket", "open binary, keys binary")

    def _state(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        held = self.held.get() or (None, None)
        return _read(held[0], _OPEN), _read(held[1], _KEYS)

    def _keep(self, open_: pd.DataFrame, keys: pd.DataFrame) -> None:
        if self.ttl_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if len(keys):
                self.handle.registerTimer(int(keys["due"].min()))
        if len(keys):
            self.held.update((_stored(open_, _OPEN), _stored(keys, _KEYS)))
        else:
            self.held.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        open_, keys = self._state()
        new = pd.concat(list(rows), ignore_index=True)
        new["start"] = (new["phase"] == "start").astype(bool)
        steps = new[_OPEN.names] if not len(open_) else pd.concat([open_, new[_OPEN.names]], ignore_index=True)
        old, codes = _key_codes(keys, steps)
        n = int(max(old.max(initial=-1), codes.max(initial=-1))) + 1
        done, due = np.zeros(n, np.int64), np.zeros(n, np.int64)
        done[old], due[old] = keys["done"], keys["due"]
        if self.ttl_ms is not None:
            timed = new[TIME].notna().to_numpy()
            last = new[TIME][timed].to_numpy("datetime64[ms]").astype(np.int64) + self.ttl_ms
            np.maximum.at(due, codes[len(open_):][timed], last)
        ms, is_start = steps["elapsed_ms"].to_numpy(np.int64), steps["start"].to_numpy(bool)
        begun, ended = np.flatnonzero(is_start), np.flatnonzero(~is_start)
        (by, place, starts), (by_end, place_end, ends) = (_ranks(codes[at], ms[at], n) for at in (begun, ended))
        pairs = np.minimum(starts, ends)
        begun, ended = begun[by], ended[by_end]
        paired, paired_end = place < pairs[codes[begun]], place_end < pairs[codes[ended]]
        first, last = begun[paired], ended[paired_end]
        found = steps.iloc[last]
        given = found["duration_ms"].to_numpy(np.float64)
        took = np.where(np.isnan(given), ms[last] - ms[first], np.nan_to_num(given).astype(np.int64))
        out = pd.DataFrame({"run_id": found["run_id"].to_numpy(), "agent": found["agent"].to_numpy(),
                            "occurrence": done[codes[last]] + place_end[paired_end] + 1, "kind": found["kind"].to_numpy(),
                            "duration_ms": took, "status": found["status"].to_numpy()})[_DURATIONS]
        rest = np.concatenate([begun[~paired], ended[~paired_end]])
        named = pd.concat([keys, new], ignore_index=True)[["run_id", "agent"]] if len(keys) else new[["run_id", "agent"]]
        numbers = np.concatenate([old, codes[len(open_):]])
        once, at = np.unique(numbers, return_index=True)
        self._keep(steps.iloc[rest], named.iloc[at].assign(done=(done + pairs)[once], due=due[once]))
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Forget the keys that are due."""
        open_, keys = self._state()
        past = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        stays = keys["due"].to_numpy(np.int64) >= past
        of_keys, of_open = _key_codes(keys, open_)
        self._keep(open_[np.isin(of_open, of_keys[stays])], keys[stays])
        return iter(())

    def close(self) -> None:
        pass


def live_durations(steps: DataFrame, ts: str | None = None, ttl_hours: float = 2.0, watermark: str = "1 hour") -> DataFrame:
    """ST4: finished pairs of a stream of trace steps, as they close.

    With an event time ``ts`` the open steps of a run are forgotten once the watermark is ``ttl_hours`` past its last one.
    """
    bucket = F.pmod(F.xxhash64("run_id", "agent"), F.lit(STEP_BUCKETS)).cast("int").alias("bucket")
    columns = [bucket, "run_id", "agent", "phase", "elapsed_ms", F.col("duration_ms").cast("double").alias("duration_ms"), "kind", "status"]
    return stateful(steps, ["bucket"], columns, PairBuckets(int(ttl_hours * 3600_000) if ts else None), DURATIONS, ts, watermark)
