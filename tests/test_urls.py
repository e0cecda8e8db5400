from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import urls

CASES = {
    "HTTPS://Example.COM:443/a/?b=2&a=1&utm_source=x#f": "https://example.com/a?a=1&b=2",
    "http://h.example:8080/": "http://h.example:8080/",
    "https://e.example/x/?b&a=1&a=0&b=": "https://e.example/x?a=1&a=0&b=&b=",
    "https://e.example": "https://e.example/",
    "https://e.example/a/../b/./c": "https://e.example/b/c",
    "https://e.example/b c?q=ü ~": "https://e.example/b%20c?q=%C3%BC+%7E",
    "https://e.example/?SI=1&si=2&six=3": "https://e.example/?six=3",
    "about:blank": "about:blank",
    "nope": None,
    "": None,
    None: None,
    "https://e.example:99999/": None,
}


def _map(spark, values, make):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return {r.k: r.o for r in rows.select("k", make(F.col("v")).alias("o")).collect()}


def test_normalize_url(spark):
    got = _map(spark, CASES, urls.normalize_url)
    assert [got[k] for k in range(len(CASES))] == list(CASES.values())


def test_url_error(spark):
    bad = ["ftp://x.example", "http://localhost", "http://localhost./x", "http://a.local", "http://x.home.arpa", "http://10.1.1.1", "http://[::1]/", "http://[::ffff:10.0.0.1]/", "nope", None, ""]
    good = ["https://example.com/", "http://8.8.8.8", "http://local.example", "http://[2001:db8::1]/"]
    got = _map(spark, bad + good, urls.url_error)
    assert [got[k] for k in range(len(bad))] == ["invalid_url"] * len(bad)
    assert [got[k] for k in range(len(bad), len(bad) + len(good))] == [None] * len(good)


def test_resolve_url(spark):
    cases = [("/a", "https://x.example/c/d?q#z", "https://x.example/a"), ("e", "https://x.example/c/d", "https://x.example/c/e"), ("?k=1", "https://x.example/c?q", "https://x.example/c?k=1"), ("#f", "https://x.example/c?q", "https://x.example/c?q#f"),
             ("//Y.example/é", "https://x.example/", "https://y.example/%C3%A9"), ("../up", "https://x.example/a/b/c", "https://x.example/a/up"), ("mailto:a@b", "https://x.example/", "mailto:a@b"), ("x", "nope", None), (None, "https://x.example/", None)]
    rows = spark.createDataFrame([(k, h, b) for k, (h, b, _) in enumerate(cases)], "k int, h string, b string")
    got = {r.k: r.o for r in rows.select("k", urls.resolve_url(F.col("h"), F.col("b")).alias("o")).collect()}
    assert [got[k] for k in range(len(cases))] == [c[2] for c in cases]


def test_strip_tracking(spark):
    cases = {"/a?utm_x=1&b=%20&ref=2#f": "/a?b=%20&ref=2#f", "/a?UTM_SOURCE=1": "/a", "/a?q=utm_": "/a?q=utm_", "/a": "/a", "?fbclid=1&&x": "?x"}
    got = _map(spark, cases, urls.strip_tracking)
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_private_addresses(spark):
    cases = {"10.0.0.1": True, "8.8.8.8": False, "fe80::1": True, "febf::": True, "fec0::1": False, "::ffff:808:808": False, "::ffff:a00:1": True, "x": True, "1.2.3": True, "100.64.0.0": True, "100.128.0.0": False}
    got = _map(spark, cases, urls.is_private_address)
    assert [got[k] for k in range(len(cases))] == list(cases.values())


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "utm_x", "si"]), st.text("ab %&", max_size=4)), max_size=5))
def test_normalising_twice_changes_nothing(spark, pairs):
    url = "https://h.example/p/?" + "&".join(f"{k}={v}" for k, v in pairs)
    once = _map(spark, [url], urls.normalize_url)[0]
    assert _map(spark, [once], urls.normalize_url)[0] == once
