"""From requests to documents: validate, route, classify, render, extract; the first error of a row stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import classify
from tessera.functions.evaluate import once
from tessera.functions.html import extract_pages
from tessera.functions.urls import bare_host, is_ipv4, is_ipv6, is_private_address, normalize_url, url_error, url_host
from tessera.operators.bounded import settled_keys, spread

MOST_LINKS = 200


def public_hosts(hosts: DataFrame, addresses: DataFrame, host_col: str = "host") -> DataFrame:
    """``hosts`` with ``host_error``: invalid_url if any address of the host is private, network if it has none.

    ``addresses(host, address)`` is the landed answer of the resolver; a host that is an address answers for itself.
    """
    known = addresses.groupBy(F.lower("host").alias("_host")).agg(F.bool_or(is_private_address(F.col("address"))).alias("_private"))
    bare = bare_host(F.col(host_col))
    joined = hosts.join(known, bare == F.col("_host"), "left")
    literal = is_ipv4(bare) | is_ipv6(bare)
    fault = F.when(literal, F.when(is_private_address(bare), "invalid_url")).when(F.col("_host").isNull(), "network").when(F.col("_private"), "invalid_url")
    return joined.withColumn("host_error", fault).drop("_host", "_private")


def session_action(fault: Column) -> Column:
    """What becomes of a session whose page has this error: closed only if it must not be looked at, else kept."""
    return F.when(fault == "invalid_url", "close").otherwise("keep")


def queued_hops(chain: Column) -> Column:
    """The hosts of a redirect chain that queue: a host that the chain already holds does not queue again."""
    return F.array_distinct(F.filter(F.transform(chain, lambda u: url_host(u)), lambda h: h.isNotNull()))


def latest_page(pages: DataFrame, by: str = "page_id") -> DataFrame:
    """Rows delivered twice once: the last landed of each id, of those landed at once the one of the highest hash.

    Which ids come more than once is found on the ids alone; only their rows are shuffled, all others stay where they
    were read. Rows with a null id stay as they are.
    """
    again = settled_keys(pages.select(by).where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(by))
    order = Window.partitionBy(by).orderBy(F.col("landed_at").desc_nulls_last(), F.xxhash64(*pages.columns).desc())
    last = pages.join(again, by, "left_semi").withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
    return spread(pages.join(again, by, "left_anti").unionByName(last.select(*pages.columns)).select(*pages.columns))


def verdicts(pages: DataFrame, length_col: str | None = None) -> DataFrame:
    """``pages`` with ``wall``, ``scripts``, ``visible``, ``reason`` and ``escalate``: native expressions only."""
    length = F.col(length_col) if length_col else F.lit(0)
    rows = classify.measured(pages)
    reason = classify.escalation_reason(F.col("status"), F.col("content_type"), F.col("wall"), F.col("scripts"), F.col("visible"), length)
    return rows.withColumn("reason", reason).withColumn("escalate", F.col("reason").isNotNull())


def fetch(pages: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """``(page_id, url, via, status, error, doc)`` of each page.

    ``pages`` (page_id, url, final_url, html, status, content_type) are plain responses, ``rendered`` (page_id, html,
    status) what a browser made of some of them. Errors, in this order: a URL that must not be fetched; a body that is
    no text; a response that will not do and was not rendered, or whose rendering failed; a status from 400 on. Each
    page is extracted once, from the html that counts; pages with an error before that are not extracted at all.
    """
    url = F.coalesce("final_url", "url")
    rows = pages.select("page_id", url.alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), "status", "content_type")
    if rendered is None:
        rows = rows.withColumn("r_html", F.lit(None).cast("string")).withColumn("r_status", F.lit(None).cast("int"))
    else:
        rows = rows.join(rendered.select("page_id", F.col("html").alias("r_html"), F.col("status").alias("r_status")), "page_id", "left")
    rows = classify.measured(rows)
    early = F.coalesce(url_error(F.col("url")), classify.gate_error(F.col("content_type"), F.col("wall")))
    reason = classify.escalation_reason(F.col("status"), F.col("content_type"), F.col("wall"), F.col("scripts"), F.col("visible"), F.lit(0))
    rows = once(rows, early=early, reason=reason)
    if rendered is not None:
        rows = classify.measured(rows, "r_html", "r_")
        failed = classify.render_error(F.col("r_status"), F.col("r_wall"), F.col("r_scripts"), F.col("r_visible"), F.col("wall"))
    else:
        failed = F.lit(None).cast("string")
    plain = F.when(F.col("wall").isNotNull(), "blocked").when(F.col("reason") == "status", "upstream_error").otherwise("not_html")
    second = F.when(F.col("reason").isNotNull(), F.when(F.col("r_html").isNull(), plain).otherwise(failed))
    by_browser = F.col("early").isNull() & F.col("reason").isNotNull() & F.col("r_html").isNotNull()
    status = F.when(by_browser, F.col("r_status")).otherwise(F.col("status"))
    rows = once(rows, via=F.when(by_browser, "browser").otherwise("http"), final_status=status, error=F.coalesce(F.col("early"), second, classify.status_error(status)))
    body = F.when(F.col("error").isNull(), F.when(F.col("via") == "browser", F.col("r_html")).otherwise(F.col("html")))
    rows = rows.select("page_id", "url", "via", F.col("final_status").alias("status"), "error", body.alias("body"))
    return extract_pages(rows, html_col="body", keep=["via", "status", "error"])


def payloads(fetched: DataFrame, include_links: bool = False) -> DataFrame:
    """What a scrape gives back: ``(page_id, key_url, url, title, markdown, via, cached, status, links, error)``."""
    links = F.slice("doc.links", 1, MOST_LINKS) if include_links else F.lit(None).cast("array<struct<href string, text string>>")
    return fetched.select("page_id", normalize_url(F.col("url")).alias("key_url"), "url", F.col("doc.title").alias("title"), F.col("doc.markdown").alias("markdown"), "via", F.lit(False).alias("cached"), "status", links.alias("links"), "error")
