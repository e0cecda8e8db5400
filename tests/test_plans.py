"""Plans that must stay as they are: what is scanned, and what is shuffled."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tessera.operators import cache, fetch

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


@needs_data
def test_a_scrape_reads_each_table_once_after_its_keys_are_settled(spark):
    plan = entry_point.queries()["scraped_requests"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) <= 3  # pages once for each delivery, cache rows


@needs_data
def test_pages_delivered_once_are_not_sorted(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    plan = fetch.latest_page(pages)._jdf.queryExecution().optimizedPlan().toString()
    once, again = plan.split("Union")[1].split("Window")[0], plan
    assert "LeftAnti" in once and "LeftSemi" in again
    got = fetch.latest_page(pages)
    assert got.count() == got.select("page_id").distinct().count() == pages.select("page_id").distinct().count()


def test_latest_page_of_ties_and_nulls(spark):
    rows = [(1, "a", 5), (1, "b", 5), (1, "c", 4), (2, "d", None), (2, "d", None), (None, "e", 1), (None, "f", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, html string, landed_at int")
    first = sorted(map(str, fetch.latest_page(df).collect()))
    assert first == sorted(map(str, fetch.latest_page(df.orderBy(F.desc("html"))).collect()))  # the same whatever the order
    assert len(first) == 4 and sum("page_id=1," in r for r in first) == 1 and not any("html='c'" in r for r in first)


def test_a_request_is_answered_once(spark):
    import json

    from tessera.functions.urls import scrape_key

    good = json.dumps({"url": "https://h.example/", "title": "t", "markdown": "m", "via": "http", "cached": False, "status": 200})
    key = spark.range(1).select(scrape_key(F.lit("https://h.example/")).alias("k")).first().k
    rows = spark.createDataFrame([(key, good, 0, 100), (key, good, 50, 120), (key, "broken", 60, 200)], "cache_key string, cache_value string, created_at bigint, expires_at bigint")
    asked = spark.createDataFrame([(1, "https://h.example/", 10), (2, "https://h.example/", 70), (3, "https://h.example/", 110), (4, "https://h.example/", 120)], "request_id bigint, url string, arrival bigint")
    got = {r.request_id: r["_from"] for r in cache.hits(asked, rows, "request_id").collect()}
    assert got == {1: 0, 2: 50, 3: 50}
