import itertools
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import actions, cache, errors, fetch, outline, pacing, search
from tessera.sources.options import Options, load_options

GOOD = json.dumps({"url": "https://h.example/", "title": "t", "markdown": "m", "via": "http", "cached": False, "status": 200})


def test_malformed_cache_values_are_misses(spark):
    bad = ["not json", "null", "[]", "{}", None, "", '"x"', GOOD.replace("200", '"200"'), GOOD.replace('"http"', '"ftp"'), GOOD.replace("false", "0"), GOOD[:-1], GOOD.replace('"m"', "null")]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate([GOOD, *bad])], "k int, cache_value string")
    assert {r.k for r in cache.with_payload(rows).where("payload is not null").collect()} == {0}


def test_cache_lifetimes(spark):
    from tessera.functions.urls import scrape_key

    key = spark.range(1).select(scrape_key(F.lit("https://h.example/")).alias("k")).first().k
    rows = spark.createDataFrame([(key, GOOD, 100, 200), (key, GOOD, 100, 200), ("x", GOOD, 0, 10**15)], "cache_key string, cache_value string, created_at bigint, expires_at bigint")
    asked = spark.createDataFrame([(1, "https://h.example/#f", 99), (2, "https://H.example", 100), (3, "https://h.example/", 199), (4, "https://h.example/", 200), (5, None, 150), (6, "https://h.example/?utm_x=1", None)], "request_id int, url string, arrival bigint")
    got = {r.request_id: r.cached for r in cache.lookup(asked, rows).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False}
    assert cache.lookup(asked, rows.where("false")).where("cached").count() == 0
    assert cache.purged(rows.distinct(), 200).first() == (1, 1)
    kept = cache.upsert(rows, spark.createDataFrame([(key, "new", 101, 300)], rows.schema))
    assert {(r.cache_key, r.cache_value) for r in kept.collect()} == {(key, "new"), ("x", GOOD)}


def test_search_is_tolerant(spark):
    bodies = [("searxng", json.dumps({"results": [{"url": "https://a.example/?utm_x=1", "title": "<b>T</b>", "content": "c"}, {"url": None}, {"url": 5}, {"url": "https://a.example", "title": "again"}, {"url": "https://b.example/", "engine": "e"}]})),
              ("brave", json.dumps({"web": {"results": [{"url": "https://c.example/", "description": "d"}]}})), ("searxng", '{"results": "nope"}'), ("searxng", "broken"), ("brave", None)]
    rows = spark.createDataFrame([(k, "q" if k < 2 else f"q{k}", p, b, None) for k, (p, b) in enumerate(bodies)], "response_id bigint, query_text string, provider string, body string, received_at timestamp")
    parsed = search.parse_results(rows)
    assert sorted((r.response_id, r.pos, r.url, r.title, r.engine) for r in parsed.collect()) == [
        (0, 0, "https://a.example/?utm_x=1", "T", "searxng:unknown"), (0, 1, "https://a.example", "again", "searxng:unknown"), (0, 2, "https://b.example/", "", "searxng:e"), (1, 0, "https://c.example/", "", "brave")]
    top = search.top_results(search.first_provider(rows, parsed), ["query_text"])
    assert sorted((r["rank"], r.url) for r in top.collect()) == [(1, "https://a.example/?utm_x=1"), (2, "https://b.example/")]
    lost = {r.query_text: r.failures for r in search.unanswered(rows, parsed).collect()}
    assert lost == {"q2": "searxng: пустая выдача", "q3": "searxng: пустая выдача", "q4": "brave: пустая выдача"}
    pages = spark.createDataFrame([("https://a.example/", "m" * 9_000, None), ("https://b.example/", None, "blocked")], "url string, markdown string, error string")
    full = {r["rank"]: (len(r.content or ""), r.truncated, r.remaining, r.error) for r in search.with_content(top, pages).collect()}
    assert full == {1: (8_000, True, 1_000, None), 2: (0, None, None, "blocked")}
    printed = search.format_results(search.with_content(top, pages), "query_text").first().text
    assert printed.startswith("Результаты по запросу «q» (2):\n\n1. **T** — a.example\n   https://a.example/?utm_x=1\n   c\n\nmmm") and "осталось ещё 1" + chr(0xA0) + "000 символов" in printed


def test_format_page(spark):
    row = spark.sql("select '' title, 'https://h.example/' url, 'http' via, true cached, 'abcdef' md, array(struct('https://x.example/' as href, '' as text)) links")
    shown = row.select(search.format_page(*(F.col(c) for c in ("title", "url", "via", "cached", "md", "links")), 4).alias("o")).first().o
    assert shown == "# Без заголовка\nhttps://h.example/ · via http · cached · 6 символов\n---\nabcd\n\n_Обрезано: осталось ещё 2 символов. Увеличь maxChars, если нужен полный текст._\n\n## Ссылки\n- [https://x.example/](https://x.example/)"


def _queue(events, most=2, apart=500):
    """Brute force: the earliest time with a free slot, far enough after the start before."""
    out, busy, last = [], [], None
    for arrival, service in events:
        t = arrival if last is None else max(arrival, last + apart)
        while sum(e > t for e in busy) >= most:
            t = min(e for e in busy if e > t)
        out.append(t)
        busy.append(t + service)
        last = t
    return out


def test_queue_against_brute_force(spark):
    import random

    rng = random.Random(7)
    rows, wanted, n = [], {}, itertools.count()
    for host in ("a", "b", None):
        at, events = 0, []
        for _ in range(60):
            at += rng.choice([0, 0, 100, 700, 3_000])
            events.append((next(n), at, rng.choice([0, 50, 900, 4_000])))
        if host:
            wanted |= dict(zip((e[0] for e in events), _queue([e[1:] for e in events])))
        rows += [(i, host, a, s) for i, a, s in events]
    df = spark.createDataFrame(rows + rows[:5] + [(999, "a", None, 1)], "request_id bigint, host string, arrival bigint, service_ms bigint")
    assert {r.request_id: r.start_at for r in pacing.queued_starts(df).collect()} == wanted
    spaced = {r.request_id: r.start_at for r in pacing.spaced_starts(df).collect()}
    assert spaced.keys() == wanted.keys() and all(spaced[k] <= wanted[k] for k in wanted)
    assert pacing.queued_starts(df.where("false")).count() == 0


def test_hints_do_not_extend(spark):
    rows = [(1, "h", 0, "browser"), (2, "h", 5, "browser"), (3, "h", 9, "http"), (4, "h", 10, "http"), (5, "h", 11, "browser"), (6, "h", 20, "browser"), (7, "h", 21, "browser")]
    df = spark.createDataFrame(rows, "request_id bigint, host string, arrival bigint, via string")
    got = {r.request_id: (r.route, r.earned) for r in pacing.hinted_routes(df, ttl_ms=10).collect()}
    assert got == {1: ("http", True), 2: ("browser", False), 3: ("browser", False), 4: ("http", False), 5: ("http", True), 6: ("browser", False), 7: ("http", True)}


def test_sessions(spark):
    rows = [(1, "s", 0), (2, "s", 600_000), (3, "s", 1_200_001), (4, None, 5)]
    df = spark.createDataFrame(rows, "request_id bigint, session_key string, arrival bigint")
    assert sorted((r.session_no, r.first_at, r.last_at, r.n_requests) for r in pacing.idle_sessions(df).collect()) == [(1, 0, 600_000, 2), (2, 1_200_001, 1_200_001, 1)]
    rows = [(1, "p", "a", 0, 10), (2, "p", "b", 1, 100), (3, "p", "c", 20, 100), (4, "p", "d", 30, 5), (5, "p", "d", 200, 5)]
    df = spark.createDataFrame(rows, "request_id bigint, host string, session_key string, arrival bigint, service_ms bigint")
    got = {r.request_id: (r.opened, r.evicted, r.refused) for r in pacing.pooled_sessions(df, most=2).collect()}
    assert got == {1: (True, None, False), 2: (True, None, False), 3: (True, "a", False), 4: (False, None, True), 5: (True, "b", False)}


def test_diffs(spark):
    pairs = [(1, "a\n  b", "a\n    c\n  d\n    c\n b"), (2, None, "x"), (3, "x\ny", " y\nx"), (4, "a", None), (5, "", "")]
    df = spark.createDataFrame(pairs, "k int, before string, after string")
    assert {r.k: r.changed for r in outline.diff_outlines(df, ["k"]).collect()} == {1: "  c\nd\n  c", 2: "x", 3: "", 4: "", 5: ""}


def test_outline_of_nothing(spark):
    from tessera.plans.queries import _AX_SCHEMA, _DOM_SCHEMA

    maps = outline.dom_maps(spark.createDataFrame([], _DOM_SCHEMA))
    lines = outline.outline_lines(outline.decorated(spark.createDataFrame([("s", 0, "1", None, [], "button", None, None, None, None)], _AX_SCHEMA), maps))
    assert [r.line for r in lines.collect()] == ["[1] button"]


def test_addresses_and_actions(spark):
    rows = spark.createDataFrame([("0-5",), (" 0-7 ",), ("1-5",), ("x",), (None,), ("0-",)], "a string")
    assert [r.o for r in rows.select(outline.parse_address(F.col("a")).alias("o")).collect()] == [5, 7, None, None, None, None]
    kept = actions.secrets_so_far(spark.createDataFrame([("s", 1, "p", "x"), ("s", 2, "p", "y"), ("s", 3, "p", "x")], "session_id string, seq int, name string, value string"))
    assert {r.seq: r["values"] for r in kept.collect()} == {1: ["x"], 2: ["x", "y"], 3: ["x", "y"]}


def test_fetch_with_rendered_pages(spark):
    words = "<p>" + "word " * 100 + "</p>"
    wall = "<script>window._cf_chl_opt={}</script>"
    pages = [(1, "https://a.example/", None, words, 200, "text/html"), (2, "https://a.example/2", None, wall, 200, "text/html"), (3, "https://a.example/3", None, wall, 200, None), (4, "https://a.example/4", None, words, 404, "text/html"),
             (5, "http://10.0.0.1/", None, words, 200, "text/html"), (6, "https://a.example/6", None, "x", 200, "image/png"), (7, "https://a.example/7", None, None, None, None), (8, "https://a.example/8", None, words, 503, None)]
    rendered = [(2, words, 200), (3, wall, 200), (8, words, 503)]
    out = fetch.fetch(spark.createDataFrame(pages, "page_id bigint, url string, final_url string, html string, status int, content_type string"), spark.createDataFrame(rendered, "page_id bigint, html string, status int"))
    got = {r.page_id: (r.via, r.error, r.doc is not None) for r in out.collect()}
    assert got == {1: ("http", None, True), 2: ("browser", None, True), 3: ("browser", "blocked", False), 4: ("http", "upstream_error", False), 5: ("http", "invalid_url", False), 6: ("http", "not_html", False), 7: ("http", "not_html", False), 8: ("browser", "upstream_error", False)}


def test_public_hosts(spark):
    hosts = spark.createDataFrame([("a.example",), ("b.example.",), ("c.example",), ("8.8.8.8",), ("10.0.0.1",), (None,)], "host string")
    known = spark.createDataFrame([("A.example", "1.1.1.1"), ("a.example", "10.0.0.1"), ("b.example", "1.1.1.1")], "host string, address string")
    assert {r.host: r.host_error for r in fetch.public_hosts(hosts, known).collect()} == {"a.example": "invalid_url", "b.example.": None, "c.example": "network", "8.8.8.8": None, "10.0.0.1": "invalid_url", None: "network"}


def test_errors(spark):
    rows = spark.createDataFrame([("blocked", "Стена"), ("timeout", "Долго."), ("x", "?")], "c string, m string")
    assert [tuple(r) for r in rows.select(errors.http_status(F.col("c")), errors.explain(F.col("c"), F.col("m"))).collect()] == [(422, "Не удалось: Стена. Попробуй другой источник — эту страницу закрывает антибот."), (504, "Не удалось: Долго. Можно повторить попытку."), (500, "Не удалось: ?.")]


def test_options(tmp_path):
    file = tmp_path / "o.json"
    file.write_text('{"idle_ms": 5, "allow_private": true, "unknown": 1, "most_sessions": 2}')
    got = load_options(str(file), {"TESSERA_MOST_SESSIONS": "3"}, page_chars=7)
    assert got == Options(idle_ms=5, most_sessions=3, page_chars=7)
    with pytest.raises(ValueError):
        load_options(None, {"TESSERA_IDLE_MS": "soon"})


def test_requests_are_validated(spark):
    from tessera.operators import validation

    cases = [
        ("/scrape", '{"url": "x"}', None, None), ("/scrape", "{}", "url", "invalid_url"), ("/scrape", '{"url": ""}', "url", "invalid_url"), ("/scrape", '{"url": "x", "refresh": "yes"}', "refresh", "invalid_request"), ("/scrape", "[]", "body", "invalid_request"),
        ("/search", '{"query": "q", "limit": 3}', None, None), ("/search", '{"query": "q", "limit": 0}', "limit", "invalid_query"), ("/search", '{"query": "q", "limit": 1.5}', "limit", "invalid_query"), ("/search", "broken", "body", "invalid_query"),
        ("/browser/fill", '{"sessionId": "s", "elementId": "0-1", "text": "", "variables": {"a": "b"}}', None, None), ("/browser/fill", '{"sessionId": "s", "elementId": "0-1", "text": "", "variables": {"a": 1}}', "variables", "invalid_request"),
        ("/browser/press", '{"sessionId": "s", "elementId": "0-1", "key": ""}', "key", "invalid_request"), ("/nowhere", "{}", None, "not_found"), ("/browser/close", None, "body", "invalid_request"),
    ]
    df = spark.createDataFrame([(k, r, b) for k, (r, b, _, _) in enumerate(cases)], "k int, route string, body string")
    got = {r.k: (r.f, r.e) for r in df.select("k", validation.bad_field(F.col("route"), F.col("body")).alias("f"), validation.request_error(F.col("route"), F.col("body")).alias("e")).collect()}
    assert [got[k] for k in range(len(cases))] == [c[2:] for c in cases]


def test_scrape_pipeline(spark):
    from tessera.functions.urls import scrape_key
    from tessera.plans import pipelines

    words = "<title>T</title><p>" + "word " * 100 + "</p>"
    at = "timestamp'2025-01-01 00:00:00'"
    pages = spark.createDataFrame([(1, "https://a.example/x/?utm_x=1", None, words, 200, "text/html"), (2, "https://a.example/gone", None, words, 404, "text/html"), (3, "https://a.example/never", None, words, 200, "text/html")], "page_id bigint, url string, final_url string, html string, status int, content_type string").withColumn("landed_at", F.expr(at))
    key = spark.range(1).select(scrape_key(F.lit("https://h.example/")).alias("k")).first().k
    rows = spark.createDataFrame([(key, GOOD, 0, 1_000)], "cache_key string, cache_value string, created_at bigint, expires_at bigint")
    asked = spark.createDataFrame([(1, "https://h.example/#x", 500), (2, "https://h.example/", 2_000), (3, "https://A.example/x", 5), (4, "https://a.example/gone", 5), (5, "http://localhost/", 5), (6, None, 5), (7, "https://a.example/x/", 6)], "request_id bigint, url string, arrival bigint")
    got = {r.request_id: (r.title, r.cached, r.error) for r in pipelines.scrape(asked, rows, pages).collect()}
    assert got == {1: ("t", True, None), 2: (None, False, "network"), 3: ("T", False, None), 4: (None, False, "upstream_error"), 5: (None, False, "invalid_url"), 6: (None, False, "invalid_url"), 7: ("T", False, None)}


def test_performed_actions(spark):
    rows = [
        ("s", 1, "fill", "0-1", ["%pw% %x%"], {"pw": "hunter2"}, "[0-1] textbox: hunter", "[0-1] textbox: hunter2\n  [0-2] text: done"), ("s", 2, "click", "0-2", [], None, "[0-2] text: hunter2", "[0-2] text: hunter2\n[0-3] hunter2"),
        ("s", 2, "click", "0-2", [], None, "[0-2] text: hunter2", "[0-2] text: hunter2\n[0-3] hunter2"), ("t", 1, "click", "0-2", [], None, "[0-2] hunter2", "[0-2] hunter2"), ("t", 2, "hover", "0-9", [], None, "[0-2] a", None), ("t", 3, "sing", "0-2", None, {}, None, None), (None, 4, "click", "0-1", [], None, "", ""), ("u", 1, "click", "0-1", [], None, "[0-1] a", "b"),
    ]
    df = spark.createDataFrame(rows, "session_id string, seq bigint, method string, element_id string, args array<string>, variables map<string, string>, before string, after string")
    opened = spark.createDataFrame([("s",), ("t",), ("t",)], "session_id string")
    got = {(r.session_id, r.seq): (r.args, r.changed, r.error) for r in actions.performed(df, opened).collect()}
    assert got == {
        ("s", 1): (["hunter2 %x%"], "[0-1] textbox: %pw%\n  [0-2] text: done", None), ("s", 2): ([], "[0-3] %pw%", None), ("t", 1): ([], "", None), ("t", 2): ([], None, "not_found"), ("t", 3): (None, None, "invalid_request"), ("u", 1): ([], None, "not_found"),
    }
    assert actions.performed(df.where("false"), opened).count() == 0


def test_session_lookups(spark):
    rows = [(1, "p", "a", 0, 10), (2, "p", "a", 20, 10), (3, "p", "a", 700_000, 1), (4, "p", "b", 700_001, 1), (5, None, "a", 5, 1)]
    df = spark.createDataFrame(rows, "request_id bigint, host string, session_key string, arrival bigint, service_ms bigint")
    got = {r.request_id: r.error for r in pacing.session_lookups(df, pacing.pooled_sessions(df)).collect()}
    assert got == {1: "not_found", 2: None, 3: "not_found", 4: "not_found", 5: "not_found"}
