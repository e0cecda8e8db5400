import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ordered, pacing


def _events(rng, n, hosts="aaaab"):
    at, rows = 0, []
    for k in range(n):
        at += rng.choice([0, 0, 10, 100, 700, 5_000, 200_000])
        rows.append((k, rng.choice(hosts), at, rng.choice([0, 5, 300, 4_000])))
    return rows


@pytest.mark.parametrize("partitions", [1, 7])
def test_running_values_against_brute_force(spark, partitions):
    rng = random.Random(partitions)
    rows = _events(rng, 400)
    marks = [(k, h, at, c, at if rng.random() < 0.3 else None) for k, h, at, c in rows]
    rng.shuffle(marks)
    df = spark.createDataFrame(marks, "id bigint, host string, arrival bigint, cost bigint, mark bigint")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for at, cost in (("arrival", "cost"), ("mark", None)):
            got = {r.id: (r.reached, r.reached_before) for r in ordered.running(df, "host", ["arrival", "id"], F.col(at), F.col(cost) if cost else 0).collect()}
            reached: dict = {}
            for k, h, a, c, m in sorted(marks, key=lambda r: (r[1], r[2], r[0])):
                value, before = a if at == "arrival" else m, reached.get(h)
                tops = [x for x in (before, value) if x is not None]
                now = max(tops) + (c if cost else 0) if tops else None
                assert got[k] == (now, before)
                reached[h] = now
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_segments_of_a_hot_key_are_many_streams(spark):
    rows = _events(random.Random(5), 500, "a")
    df = spark.createDataFrame(rows, "request_id bigint, host string, arrival bigint, service_ms bigint")
    cut = pacing._after_gaps(df.select("request_id", "host", "arrival"), "host", 100_000)
    assert cut.select("segment").distinct().count() == 1 + sum(b[2] - a[2] >= 100_000 for a, b in zip(rows, rows[1:]))


def test_nothing_runs_over_nothing(spark):
    df = spark.createDataFrame([], "request_id bigint, host string, arrival bigint, service_ms bigint, via string, session_key string")
    for done in (pacing.spaced_starts(df), pacing.queued_starts(df), pacing.hinted_routes(df), pacing.idle_sessions(df)):
        assert done.count() == 0
