"""Per-host pacing, hints, sessions: batch forms of what the streaming package keeps as state. Times are epoch milliseconds."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import running, segments
from tessera.operators.sequential import fold

MOST_AT_ONCE, LEAST_APART_MS = 2, 500
HINT_TTL_MS = 24 * 3_600_000
IDLE_MS, MOST_SESSIONS = 600_000, 5


def spaced_starts(requests: DataFrame, apart_ms: int = LEAST_APART_MS) -> DataFrame:
    """``(request_id, host, arrival, start_at, waited)``: starts of one host at least ``apart_ms`` apart, in order of arrival.

    The recurrence start = max(arrival, start before + apart) is a running value: no state and no task per host. Rows
    without host or arrival queue nowhere; rows delivered twice count once.
    """
    rows = requests.select("request_id", "host", "arrival").where("host is not null and arrival is not null").distinct()
    start = F.col("reached") - apart_ms
    return running(rows, "host", ["arrival", "request_id"], F.col("arrival"), apart_ms).select("request_id", "host", "arrival", start.alias("start_at"), (start - F.col("arrival")).alias("waited"))


def queue_step(state: dict, arrival: int, service: int, most: int, apart_ms: int) -> tuple[int, int]:
    """(start, end) of the next request of a host: a free slot, and ``apart_ms`` after the start before."""
    busy = state["busy"]
    start = max(arrival, state["last"] + apart_ms) if state["last"] is not None else arrival
    while busy and busy[0] <= start:
        heapq.heappop(busy)
    if len(busy) >= most:
        start = max(start, heapq.heappop(busy))
        while busy and busy[0] <= start:
            heapq.heappop(busy)
    heapq.heappush(busy, start + service)
    state["last"] = start
    return start, start + service


def queued_starts(requests: DataFrame, most: int = MOST_AT_ONCE, apart_ms: int = LEAST_APART_MS) -> DataFrame:
    """``(request_id, host, arrival, start_at, end_at)``: at most ``most`` requests of a host at once, first come first served.

    Null and negative service times count as 0. A true recurrence: read as a stream, but cut where the queue is empty
    for sure, which is when even one request at a time would be done with all before; so a host is many streams.
    """
    rows = requests.select("request_id", "host", "arrival", F.greatest(F.coalesce("service_ms", F.lit(0)), F.lit(0)).alias("service_ms"))
    rows = rows.where("host is not null and arrival is not null").distinct()

    def step(state: dict, event: tuple) -> list[tuple]:
        start, end = queue_step(state, int(event.arrival), int(event.service_ms), most, apart_ms)
        return [(event.request_id, event.host, int(event.arrival), start, end)]

    served = running(rows, "host", ["arrival", "request_id"], F.col("arrival"), F.greatest(F.col("service_ms"), F.lit(apart_ms)))
    idle = F.col("reached_before").isNull() | (F.col("reached_before") <= F.col("arrival"))
    rows = segments(served, "host", ["arrival", "request_id"], idle)
    return fold(rows, "segment", ["arrival", "request_id"], lambda: {"busy": [], "last": None}, step, "request_id bigint, host string, arrival bigint, start_at bigint, end_at bigint")


def _after_gaps(rows: DataFrame, key: str, gap_ms: int) -> DataFrame:
    """``rows`` with ``segment``: cut where the request before is at least ``gap_ms`` old."""
    order = ["arrival", "request_id"]
    seen = running(rows, key, order, F.col("arrival"))
    return segments(seen, key, order, F.col("reached_before").isNull() | (F.col("arrival") - F.col("reached_before") >= gap_ms))


def hinted_routes(requests: DataFrame, ttl_ms: int = HINT_TTL_MS) -> DataFrame:
    """``(request_id, host, arrival, route, earned)``: a host that needed a browser is sent there for ``ttl_ms``.

    A request that went by browser of its own earns the hint; those sent there by a hint do not extend it, so a host
    gets a fresh chance when the time is up (at that very moment, too). Hosts are cut where nobody asked for so long
    that no hint can be left.
    """
    rows = requests.select("request_id", "host", "arrival", "via").where("host is not null and arrival is not null").distinct()

    def step(state: dict, event: tuple) -> list[tuple]:
        at = int(event.arrival)
        hinted = state["until"] is not None and state["until"] > at
        earned = not hinted and event.via == "browser"
        if earned:
            state["until"] = at + ttl_ms
        return [(event.request_id, event.host, at, "browser" if hinted else "http", earned)]

    rows = _after_gaps(rows, "host", ttl_ms)
    return fold(rows, "segment", ["arrival", "request_id"], lambda: {"until": None}, step, "request_id bigint, host string, arrival bigint, route string, earned boolean")


def cached_answers(requests: DataFrame, ttl_ms: int = HINT_TTL_MS, url_key: str = "key") -> DataFrame:
    """``(request_id, key, arrival, cached)``: a miss writes the answer for ``ttl_ms``, hits do not extend it."""
    rows = requests.select("request_id", url_key, "arrival").where(F.col(url_key).isNotNull() & F.col("arrival").isNotNull()).distinct()

    def step(state: dict, event: tuple) -> list[tuple]:
        at = int(event.arrival)
        hit = state["until"] is not None and state["until"] > at
        if not hit:
            state["until"] = at + ttl_ms
        return [(event.request_id, getattr(event, url_key), at, hit)]

    rows = _after_gaps(rows, url_key, ttl_ms)
    return fold(rows, "segment", ["arrival", "request_id"], lambda: {"until": None}, step, f"request_id bigint, {url_key} string, arrival bigint, cached boolean")


def idle_sessions(requests: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """``(session_key, session_no, first_at, last_at, n_requests)``: a session ends when it was idle for more than ``idle_ms``.

    A request exactly ``idle_ms`` after the one before still belongs to it.
    """
    rows = requests.select("request_id", "session_key", "arrival").where("session_key is not null and arrival is not null").distinct()
    runs = _after_gaps(rows, "session_key", idle_ms + 1).groupBy("session_key", "segment_start").agg(F.min("arrival").alias("first_at"), F.max("arrival").alias("last_at"), F.count(F.lit(1)).alias("n_requests"))
    number = F.row_number().over(Window.partitionBy("session_key").orderBy("first_at")).cast("bigint")  # a row per session, not per request
    return runs.select("session_key", number.alias("session_no"), "first_at", "last_at", "n_requests")


def session_names(opened: DataFrame, at_col: str = "arrival", order: str = "request_id") -> DataFrame:
    """``opened`` with ``session_id``: the time of opening and a count over all openings, both to base 36.

    The count runs by time and ``order`` over range partitions, so it is dense without a task for all; rows without a
    time have no name.
    """
    rows = opened.withColumn("_all", F.lit("all")).where(F.col(at_col).isNotNull())
    counted = running(rows, "_all", [at_col, order], F.lit(0), 1)
    name = F.concat(F.lit("s_"), F.lower(F.conv(F.col(at_col).cast("string"), 10, 36)), F.lower(F.conv(F.col("reached").cast("string"), 10, 36)))
    return counted.withColumn("session_id", name).drop("_all", "reached", "reached_before").unionByName(opened.where(F.col(at_col).isNull()).withColumn("session_id", F.lit(None).cast("string")))


def session_lookups(asked: DataFrame, pooled: DataFrame) -> DataFrame:
    """``asked`` (request_id, ...) with ``found`` and ``error``: not_found where the request's session was not open before it.

    ``pooled`` is what :func:`pooled_sessions` makes of the same requests: a request that opened its session, or was
    refused, asked for one that was not there.
    """
    open_ = pooled.select("request_id", (~F.col("opened") & ~F.col("refused")).alias("found"))
    joined = asked.join(open_, "request_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return joined.withColumn("error", F.when(~F.col("found"), "not_found"))


def pooled_sessions(requests: DataFrame, most: int = MOST_SESSIONS, idle_ms: int = IDLE_MS, pool: str = "host") -> DataFrame:
    """``(request_id, pool, session_key, opened, evicted, refused)``: a pool holds ``most`` sessions.

    A request of a session that is not open opens it; if the pool is full then, the free session used longest ago is
    evicted, or, if all are serving a request, the newcomer is refused. Sessions idle for more than ``idle_ms`` are
    dropped before. Each pool is a stream of its own.
    """
    rows = requests.select("request_id", F.col(pool).alias("pool"), "session_key", "arrival", F.greatest(F.coalesce("service_ms", F.lit(0)), F.lit(0)).alias("service_ms"))
    rows = rows.where("pool is not null and session_key is not null and arrival is not null").distinct()

    def step(state: dict, event: tuple) -> list[tuple]:
        at, name, live = int(event.arrival), event.session_key, state["live"]
        for other in [k for k, (used, until) in live.items() if until <= at and used < at - idle_ms]:
            del live[other]
        opened, evicted, refused = name not in live, None, False
        if opened and len(live) >= most:
            free = [k for k, (_, until) in live.items() if until <= at]
            if free:
                evicted = min(free, key=lambda k: (live[k][0], k))
                del live[evicted]
            else:
                opened, refused = False, True
        if not refused:
            live[name] = (at, at + int(event.service_ms))
        return [(event.request_id, event.pool, name, opened, evicted, refused)]

    return fold(rows, "pool", ["arrival", "request_id"], lambda: {"live": {}}, step, "request_id bigint, pool string, session_key string, opened boolean, evicted string, refused boolean")
