"""The two journeys of a request as one plan each: a page, and a search with its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.evaluate import once
from tessera.functions.urls import normalize_url, url_error
from tessera.operators import cache as caching
from tessera.operators import fetch as fetching
from tessera.operators import search as searching
from tessera.operators.bounded import settled_keys
from tessera.session import settle


def scrape(requests: DataFrame, cache: DataFrame, pages: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """``(request_id, url, title, markdown, via, cached, status, error)`` of each request (request_id, url, arrival).

    Requests for what must not be fetched fail; those that the cache answers are done; the others are joined with the
    landed pages of their normalised URL. First keys decide, without payloads and html: which row of the cache answers
    a request, and which page answers a missed key. Then the html of those pages alone is fetched and extracted, once
    each, and payloads are joined.
    """
    asked = once(requests, fault=url_error(F.col("url")), key_url=normalize_url(F.col("url")))
    found = caching.hits(requests, cache, "request_id")
    asked = settle(asked.join(found, "request_id", "left").select("request_id", "url", "fault", "key_url", "_key", "_from"))
    allowed, cached = F.col("fault").isNull(), F.col("_key").isNotNull()
    missed = asked.where(allowed & ~cached & F.col("key_url").isNotNull()).select("key_url").distinct()
    keyed = once(pages.select("page_id", "url", "landed_at"), key_url=normalize_url(F.col("url")))
    first = keyed.groupBy("key_url").agg(F.max_by("page_id", F.struct("landed_at", "page_id")).alias("page_id"))
    wanted = settled_keys(first.join(settled_keys(missed), "key_url", "left_semi"))
    landed = fetching.latest_page(pages.join(wanted.select("page_id"), "page_id", "left_semi"))
    got = fetching.payloads(fetching.fetch(landed, rendered)).drop("key_url").join(wanted, "page_id")
    got = got.select("key_url", F.struct("url", "title", "markdown", "via", F.col("status").cast("double").alias("status"), "error").alias("page"))
    hit = caching.valid_rows(cache).select("_key", "_from", F.col("_hit").alias("hit"))
    done = asked.join(hit, ["_key", "_from"], "left").join(got, "key_url", "left")
    pick = lambda name: F.when(allowed, F.when(cached, F.col(f"hit.{name}")).otherwise(F.col(f"page.{name}")))
    fault = F.when(~allowed, F.col("fault")).when(~cached, F.when(F.col("page").isNull(), "network").otherwise(F.col("page.error")))
    return done.select("request_id", F.coalesce(pick("url"), F.col("url")).alias("url"), *(pick(n).alias(n) for n in ("title", "markdown", "via")), (allowed & cached).alias("cached"), pick("status").alias("status"), fault.alias("error"))


def search(responses: DataFrame, payloads: DataFrame | None = None, limit: int = searching.DEFAULT_LIMIT) -> DataFrame:
    """The ranked results of each query, from its first provider that has any; with ``payloads`` also their content."""
    results = searching.parse_results(responses.dropDuplicates(["response_id"]))
    best = searching.first_provider(responses, results)
    top = searching.top_results(best, ["query_text"], limit)
    if payloads is not None:
        top = searching.with_content(top, payloads)
    return top
