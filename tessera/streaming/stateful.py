"""The stateful operators on streams. Event time has a watermark, which the batch forms do not need.

Rows that are later than the watermark are dropped, and so is the state of a key once the watermark has passed the
time up to which it matters. A key's rows of one micro-batch are held at once, so the source's limit per trigger
(``maxFilesPerTrigger`` and the like) bounds what a hot key can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.urls import dedupe_key
from tessera.operators.cache import latest
from tessera.operators.pacing import HINT_TTL_MS, IDLE_MS, LEAST_APART_MS, MOST_AT_ONCE, queue_step

LATENESS = "10 minutes"
#: Parts of the streamed cache table; a micro-batch rewrites only those it has rows of.
BUCKETS = 64


def _timed(requests: DataFrame, lateness: str, *columns: Any) -> DataFrame:
    """The requests that have a host and an arrival, with the watermark on it."""
    rows = requests.where("host is not null and arrival is not null").select("request_id", "host", "arrival", *columns, F.timestamp_millis(F.col("arrival")).alias("at"))
    return rows.withWatermark("at", lateness)


def _keep(state: GroupState, value: tuple, until: int) -> None:
    """Keeps the state up to the event time ``until``; what is over by the watermark already is dropped at once."""
    if until <= state.getCurrentWatermarkMs():
        state.remove()
    else:
        state.update(value)
        state.setTimeoutTimestamp(until)


def _sorted(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = [p for p in parts if len(p)]
    return pd.concat(rows).sort_values(["arrival", "request_id"], kind="stable") if rows else pd.DataFrame()


def hinted_routes(requests: DataFrame, ttl_ms: int = HINT_TTL_MS, lateness: str = LATENESS) -> DataFrame:
    """As the batch form, per micro-batch in order of arrival; a host's state is the time its hint ends."""
    names = ["request_id", "host", "arrival", "route", "earned"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(columns=names)
            return
        until = state.get[0] if state.exists else -1
        out = []
        for e in _sorted(parts).itertuples(index=False):
            hinted = until > e.arrival
            earned = not hinted and e.via == "browser"
            until = int(e.arrival) + ttl_ms if earned else until
            out.append((e.request_id, key[0], int(e.arrival), "browser" if hinted else "http", earned))
        if until >= 0 or state.exists:
            _keep(state, (until,), until)
        yield pd.DataFrame(out, columns=names)

    return _timed(requests, lateness, "via").groupBy("host").applyInPandasWithState(step, "request_id bigint, host string, arrival bigint, route string, earned boolean", "until bigint", "append", GroupStateTimeout.EventTimeTimeout)


def queued_starts(requests: DataFrame, most: int = MOST_AT_ONCE, apart_ms: int = LEAST_APART_MS, lateness: str = LATENESS) -> DataFrame:
    """As the batch form; a host's state is the end of its running requests (``most`` of them) and its last start."""
    names = ["request_id", "host", "arrival", "start_at", "end_at"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(columns=names)
            return
        busy, last = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        known: dict[str, Any] = {"busy": busy, "last": None if last is None or last < 0 else last}
        out = []
        for e in _sorted(parts).itertuples(index=False):
            start, end = queue_step(known, int(e.arrival), int(e.service_ms), most, apart_ms)
            out.append((e.request_id, key[0], int(e.arrival), start, end))
        last = -1 if known["last"] is None else known["last"]
        _keep(state, (sorted(known["busy"]), last), max([last + apart_ms, *known["busy"]]))
        yield pd.DataFrame(out, columns=names)

    service = F.greatest(F.coalesce("service_ms", F.lit(0)), F.lit(0)).cast("bigint")
    rows = _timed(requests, lateness, service.alias("service_ms"))
    return rows.groupBy("host").applyInPandasWithState(step, "request_id bigint, host string, arrival bigint, start_at bigint, end_at bigint", "busy array<bigint>, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def idle_sessions(requests: DataFrame, idle_ms: int = IDLE_MS, lateness: str = LATENESS) -> DataFrame:
    """``(session_key, first_at, last_at, n_requests)`` of sessions that ended, by session windows under a watermark."""
    at = F.timestamp_millis(F.col("arrival"))
    rows = requests.where("session_key is not null and arrival is not null").select("session_key", "arrival", at.alias("at")).withWatermark("at", lateness)
    gap = F.session_window("at", f"{idle_ms} milliseconds")  # windows that touch are one: exactly idle_ms later still belongs
    return rows.groupBy("session_key", gap).agg(F.min("arrival").alias("first_at"), F.max("arrival").alias("last_at"), F.count(F.lit(1)).alias("n_requests")).drop("session_window")


def first_results(results: DataFrame, at_col: str = "received_at", lateness: str = LATENESS) -> DataFrame:
    """The first result of each page of a query within the watermark."""
    keyed = results.withColumn("page", dedupe_key(F.col("url"))).withWatermark(at_col, lateness)
    return keyed.dropDuplicatesWithinWatermark(["query_text", "page"])


def write_cache(writes: DataFrame, path: str, checkpoint: str, *, buckets: int = BUCKETS, trigger: dict | None = None) -> Any:
    """A query that upserts cache rows into the bucketed Parquet table at ``path``, by default what is there now.

    A micro-batch rewrites only the buckets (by hash of the key) that it has rows of, under ``data/epoch=…/bucket=…``,
    and then writes ``manifest/epoch=…``, one file that names each bucket's epoch; readers take the last manifest, so
    they see a batch whole or not at all, and a batch that is tried again writes the same files. Epochs that neither of
    the last two manifests names are deleted. ``trigger`` goes to ``DataStreamWriter.trigger``.
    """

    def upsert_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.where("cache_key is not null").withColumn("bucket", F.pmod(F.xxhash64("cache_key"), F.lit(buckets)).cast("int")).persist()
        touched = {r.bucket for r in rows.select("bucket").distinct().collect()}  # at most ``buckets`` of them
        before = {b: e for b, e in _manifest(spark, path, epoch).items()}
        old = [f"{path}/data/epoch={before[b]}/bucket={b}" for b in sorted(touched) if b in before]
        merged = latest(rows if not old else rows.unionByName(spark.read.option("basePath", f"{path}/data").parquet(*old).select(*rows.columns)))
        if touched:
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/epoch={epoch}")
        now = before | dict.fromkeys(touched, epoch)
        spark.createDataFrame(sorted(now.items()), "bucket int, written bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/epoch={epoch}")
        rows.unpersist()
        _sweep(spark, path, set(now.values()) | set(before.values()) | {epoch})

    stream = writes.writeStream.foreachBatch(upsert_batch).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()


def _manifest(spark: Any, path: str, before: int | None = None) -> dict[int, int]:
    """Epoch of each bucket by the last manifest (before an epoch); empty before the first."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.option("basePath", f"{path}/manifest").parquet(f"{path}/manifest")
    except AnalysisException:
        return {}
    rows = rows if before is None else rows.where(F.col("epoch") < before)
    last = rows.agg(F.max("epoch")).first()[0]
    return {} if last is None else {r.bucket: r.written for r in rows.where(F.col("epoch") == last).collect()}  # a row per bucket


def _sweep(spark: Any, path: str, named: set[int]) -> None:
    """Deletes the epochs of data and manifests that no reader needs any more."""
    context = spark._jvm.org.apache.hadoop.fs
    newest = max(named)
    for folder, keep in (("data", lambda e: e in named), ("manifest", lambda e: e >= newest - 1 or e in named)):
        root = context.Path(f"{path}/{folder}")
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in files.listStatus(root) if files.exists(root) else ():
            name = status.getPath().getName()
            if name.startswith("epoch=") and not keep(int(name.split("=")[1])):
                files.delete(status.getPath(), True)


def read_cache(spark: Any, path: str) -> DataFrame | None:
    """The table that :func:`write_cache` keeps, as of its last manifest, or None before the first."""
    held = _manifest(spark, path)
    if not held:
        return None
    return spark.read.option("basePath", f"{path}/data").parquet(*(f"{path}/data/epoch={e}/bucket={b}" for b, e in sorted(held.items()))).drop("epoch", "bucket")
