"""Reuse of results under a time to live: lookup, validation, purge, upsert. Times are epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.evaluate import once
from tessera.functions.urls import scrape_key

DEFAULT_TTL_MS = 24 * 3_600_000
PAYLOAD = "url string, title string, markdown string, via string, cached boolean, status double, links array<struct<href string, text string>>"


def with_payload(df: DataFrame, value_col: str = "cache_value", name: str = "payload") -> DataFrame:
    """``df`` with the cached value as a struct, null if it is broken JSON or of a wrong shape.

    All of url, title, markdown, via (http or browser), cached and status must be there with their types; links may be
    left out. Every malformed value reads as a miss. The JSON is parsed once.
    """
    parsed = once(df, _variant=F.try_parse_json(F.col(value_col)))
    return once(parsed, **{name: _payload(F.col("_variant"), F.col(value_col))}).drop("_variant")


def _payload(variant: Column, value: Column) -> Column:
    kind = lambda name: F.schema_of_variant(F.try_variant_get(variant, f"$.{name}", "variant"))
    text = [kind(n) == "STRING" for n in ("url", "title", "markdown", "via")]
    number = F.coalesce(kind("status").rlike("^(BIGINT|DOUBLE|DECIMAL.*|TINYINT|SMALLINT|INT)$"), F.lit(False))
    shape = F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    parsed = F.from_json(value, PAYLOAD)
    good = shape & number & (kind("cached") == "BOOLEAN") & parsed["via"].isin("http", "browser")
    for t in text:
        good = good & t
    links = F.try_variant_get(variant, "$.links", "variant")
    good = good & (links.isNull() | F.schema_of_variant(links).startswith("ARRAY"))
    return F.when(F.coalesce(good, F.lit(False)), parsed)


def latest(cache: DataFrame) -> DataFrame:
    """One row per key: the last written, which is what an upsert leaves. Rows delivered twice count once."""
    first = ["created_at", "expires_at", "cache_value"]
    rest = [c for c in cache.columns if c not in first]
    last = cache.where("cache_key is not null").groupBy(F.col("cache_key").alias("_key")).agg(F.max(F.struct(*first, *rest)).alias("_last"))
    return last.select(*(F.col(f"_last.{c}").alias(c) for c in cache.columns))


def upsert(cache: DataFrame, writes: DataFrame) -> DataFrame:
    """The cache after ``writes`` (same columns): each key has the value written last."""
    return latest(cache.unionByName(writes.select(*cache.columns)))


def delete(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """The cache without the ``keys`` (column cache_key)."""
    return cache.join(keys.select("cache_key").distinct(), "cache_key", "left_anti")


def unexpired(cache: DataFrame, now: Column | int) -> DataFrame:
    """What a purge at ``now`` keeps: a row whose time is up at that very moment goes."""
    return cache.where(F.col("expires_at") > (F.lit(now) if isinstance(now, int) else now))


def purged(cache: DataFrame, now: int) -> DataFrame:
    """``(purged_rows, kept_rows)``: what a purge at ``now`` would do."""
    gone = F.coalesce(F.col("expires_at") <= now, F.lit(False))
    return cache.agg(F.count_if(gone).alias("purged_rows"), F.count_if(~gone).alias("kept_rows"))


def valid_rows(cache: DataFrame) -> DataFrame:
    """``(_key, _from, _until, _hit)`` of the well-formed rows that ever were valid; of those written at once the longest valid."""
    rows = cache.select(F.col("cache_key").alias("_key"), F.col("created_at").alias("_from"), F.col("expires_at").alias("_until"), "cache_value")
    rows = with_payload(rows, name="_hit").drop("cache_value").where("_hit is not null and _until > _from")
    best = rows.groupBy("_key", "_from").agg(F.max_by(F.struct("_until", "_hit"), "_until").alias("_v"))
    return best.select("_key", "_from", F.col("_v._until").alias("_until"), F.col("_v._hit").alias("_hit"))


def _valid_at(asked: str, at: str, fresh: Column) -> Column:
    return (F.col(asked) == F.col("_key")) & (F.col("_from") <= F.col(at)) & (F.col("_until") > F.col(at)) & fresh


def hits(requests: DataFrame, cache: DataFrame, id_col: str, *, url_col: str = "url", at_col: str = "arrival") -> DataFrame:
    """``(id_col, _key, _from)`` of the requests that the cache answers: the key and time of the row written last by then.

    No payload is carried: join :func:`valid_rows` by both columns for it. One row per id.
    """
    rows = valid_rows(cache).select("_key", "_from", "_until")
    asked = once(requests.select(id_col, F.col(at_col).alias("_at"), url_col), _asked=scrape_key(F.col(url_col))).select(id_col, "_at", "_asked")
    met = asked.join(rows, _valid_at("_asked", "_at", F.lit(True)))
    return met.groupBy(id_col).agg(F.max(F.struct("_from", "_key")).alias("_v")).select(id_col, F.col("_v._key").alias("_key"), F.col("_v._from").alias("_from"))


def lookup(requests: DataFrame, cache: DataFrame, *, url_col: str = "url", at_col: str = "arrival", refresh_col: str | None = None) -> DataFrame:
    """``requests`` with ``hit`` (the payload struct or null) and ``cached``.

    A hit has the key of the request's URL, was written by then, is not expired then and is well-formed; requests that
    ask for a refresh never hit. An equality join on the key with the validity as residual: no task per key. Where
    several rows of a key are valid at once the request comes with each; :func:`hits` takes the last.
    """
    asked = once(requests, _asked=scrape_key(F.col(url_col)))
    fresh = F.lit(True) if refresh_col is None else ~F.coalesce(F.col(refresh_col), F.lit(False))
    joined = asked.join(valid_rows(cache), _valid_at("_asked", at_col, fresh), "left")
    return joined.withColumn("hit", F.col("_hit")).withColumn("cached", F.col("_hit").isNotNull()).drop("_asked", "_key", "_from", "_until", "_hit")


def writable(payloads: DataFrame, *, error_col: str = "error", status_col: str = "status") -> DataFrame:
    """What may be cached: no error and a status under 400."""
    return payloads.where(F.col(error_col).isNull() & (F.col(status_col) < 400))
