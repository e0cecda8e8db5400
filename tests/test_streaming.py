import json

from pyspark.sql import functions as F

from tessera.operators import pacing
from tessera.sources.providers import register
from tessera.streaming import stateful

SCHEMA = "request_id bigint, host string, session_key string, via string, arrival bigint, service_ms bigint"


def _stream(spark, tmp_path, rows, parts=2):
    """The rows as a stream of ``parts`` micro-batches in order of arrival."""
    rows = sorted(rows, key=lambda r: (r[4], r[0]))
    folder = str(tmp_path / "in")
    for k in range(parts):
        piece = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(piece, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def _run(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


ROWS = [(k, f"h{k % 2}", f"s{k % 3}", "browser" if k % 4 == 0 else "http", 1_000_000 + k * 300 + (k % 5) * 40, 700) for k in range(40)]


def test_streams_give_what_the_batch_gives(spark, tmp_path):
    batch = spark.createDataFrame(ROWS, SCHEMA)
    stream = _stream(spark, tmp_path, ROWS)
    got = _run(stateful.queued_starts(stream), "queued")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pacing.queued_starts(batch).collect()))
    got = _run(stateful.hinted_routes(stream, ttl_ms=2_000), "hinted")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pacing.hinted_routes(batch, ttl_ms=2_000).collect()))


def test_idle_sessions_end_by_watermark(spark, tmp_path):
    rows = [(1, "h", "s", "http", 0, 0), (2, "h", "s", "http", 600_000, 0), (3, "h", "s", "http", 1_200_001, 0), (4, "h", "z", "http", 10_000_000, 0), (5, "h", "z", "http", 10_000_001, 0)]
    got = _run(stateful.idle_sessions(_stream(spark, tmp_path, rows, 3)), "idle")
    assert sorted((r.session_key, r.first_at, r.last_at, r.n_requests) for r in got.collect()) == [("s", 0, 600_000, 2), ("s", 1_200_001, 1_200_001, 1)]


def test_cache_upserts(spark, tmp_path):
    schema = "cache_key string, cache_value string, created_at bigint, expires_at bigint"
    folder = str(tmp_path / "w")
    for rows in ([("a", "1", 1, 9), ("b", "1", 1, 9)], [("a", "2", 2, 9)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    writes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stateful.write_cache(writes, str(tmp_path / "cache"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.cache_key, r.cache_value) for r in stateful.read_cache(spark, str(tmp_path / "cache")).collect()} == {("a", "2"), ("b", "1")}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    schema = "cache_key string, cache_value string, created_at bigint, expires_at bigint"
    folder, cache = str(tmp_path / "w"), tmp_path / "cache"
    for rows in ([(f"k{k}", "1", 1, 9) for k in range(40)], [("k1", "2", 2, 9)], [("k1", "3", 3, 9), (None, "x", 3, 9)], [("k1", "0", 1, 9)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    writes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stateful.write_cache(writes, str(cache), str(tmp_path / "cp"), buckets=8).awaitTermination()
    got = {r.cache_key: r.cache_value for r in stateful.read_cache(spark, str(cache)).collect()}
    assert got == {f"k{k}": "3" if k == 1 else "1" for k in range(40)}
    epochs = {x.name: len(list(x.glob("bucket=*"))) for x in (cache / "data").glob("epoch=*")}
    assert max(epochs.values()) == 8 and sorted(epochs.values())[:-1] == [1] * (len(epochs) - 1) and len(epochs) <= 3
    assert len(list((cache / "manifest").glob("epoch=*"))) <= 3


def test_response_log_and_table_function(spark, tmp_path):
    register(spark)
    for provider, body in (("searxng", {"results": [{"url": "u", "title": "t"}, {"url": 1}]}), ("brave", {"web": {"results": [{"url": "v"}]}})):
        (tmp_path / provider).mkdir()
        (tmp_path / provider / "1.json").write_text(json.dumps(body))
    spark.read.format("response_log").load(str(tmp_path)).createOrReplaceTempView("log")
    got = spark.sql("select l.provider, i.pos, i.url, i.title from log l, lateral search_items(l.provider, l.body) i")
    assert sorted(map(tuple, got.collect())) == [("brave", 0, "v", ""), ("searxng", 0, "u", "t")]


def test_first_results(spark, tmp_path):
    rows = spark.createDataFrame([("q", "https://a.example/", 1), ("q", "https://a.example/#x", 2), ("r", "https://a.example/", 3)], "query_text string, url string, t bigint")
    rows.coalesce(1).write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "r"))
    assert _run(stateful.first_results(stream.withColumn("received_at", F.timestamp_seconds("t"))), "firsts").count() == 2
