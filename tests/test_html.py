import pytest
from pyspark.sql import functions as F

from tessera.functions import classify
from tessera.functions.html import DOCUMENT, extract, extract_pages

PAGE = """<!doctype html><html lang=de><head><title> A &amp; B </title><meta property="og:description" content="d"><base href="/base/"></head><body>
<nav><a href="/nav">N</a></nav><article><h1>Head<a href="#x">#</a></h1><p>One <b>two<p>three <img alt="pic" src=i.png>four {long}
<a href="x?utm_source=1&k=2">link</a><script>var t="</p>";</script><pre class="language-py"><span class=lang>py</span><code>a ``` b
</code></pre><table><tr><th>A<th>B<tr><td>1<td>2</table><table><tr><td>layout</td></tr></table><ol><li>one<li>two</ol></article><footer>F</footer></body></html>"""


def test_extract():
    doc = extract(PAGE.replace("{long}", "word " * 60), "https://h.example/p")
    assert doc["title"] == "A & B" and doc["description"] == "d" and doc["meta"]["lang"] == "de"
    assert [x["href"] for x in doc["links"]] == ["https://h.example/nav", "https://h.example/base/x?k=2"]
    md = doc["markdown"]
    assert "# Head\n" in md and "изображение: pic" in md and "````py\na ``` b\n````" in md and "| A | B |\n| --- | --- |\n| 1 | 2 |" in md and "1.  one\n2.  two" in md
    assert "layout" in md and "var t" not in md and "N](" not in md and "F" not in md.split("\n")
    assert doc["text_length"] > 200


def test_extract_defined_for_anything():
    for html in (None, "", "  ", "<", "<p", "<b><i></b></i>", "\x00", "<div>" * 3000 + "x", "<table><tr><td>" * 200):
        assert set(extract(html, None)) == {"markdown", "title", "description", "links", "meta", "text_length"}
    assert extract("<p>hidden words</p><div hidden>gone</div>", "https://h.example/")["markdown"] == "hidden words"


def test_extract_pages_in_spark(spark):
    rows = spark.createDataFrame([(1, "<p>a</p>", "https://h.example/", "x"), (2, None, None, "y"), (1, "<p>a</p>", "https://h.example/", "x")], "page_id bigint, html string, url string, doc string")
    out = extract_pages(rows.select("page_id", "html", "url"))
    assert out.schema["doc"].dataType == DOCUMENT
    assert sorted((r.page_id, r.doc and r.doc.markdown) for r in out.collect()) == [(1, "a"), (1, "a"), (2, None)]
    assert extract_pages(rows.where("false").select("page_id", "html", "url")).count() == 0


def test_one_evaluation_a_page(spark):
    rows = spark.createDataFrame([(1, "<p>a</p>", "u", "text/html")], "page_id bigint, html string, url string, content_type string")
    out = extract_pages(rows.where(classify.is_textual(F.col("content_type")))).where("doc.text_length > 0").select("doc.title", "doc.markdown")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_verdict_boundaries(spark):
    shell = lambda s, w: "<html><body><p>" + "w" * w + "</p><script>" + "s" * (s - 17) + "</script></body></html>"
    cases = [(shell(40 * 1_199, 1_199), None), (shell(40 * 1_199 + 1, 1_199), "thin_spa"), (shell(48_001, 1_200), None), (shell(80 * 1_300, 1_300), None), (shell(80 * 1_300 + 1, 1_300), "thin_spa"), ("", "empty_body")]
    rows = spark.createDataFrame([(k, h, 200, None) for k, (h, _) in enumerate(cases)], "k int, html string, status int, content_type string")
    rows = classify.measured(rows)
    reason = classify.escalation_reason(*(F.col(c) for c in ("status", "content_type", "wall", "scripts", "visible")), F.lit(0))
    got = {r.k: r.reason for r in rows.select("k", reason.alias("reason")).collect()}
    assert [got[k] for k in range(len(cases))] == [c[1] for c in cases]


def _body(html: str, url: str = "https://h.example/dir/page") -> str:
    return extract(f"<body><article><p>{'long words ' * 30}</p>{html}</article></body>", url)["markdown"].split("\n\n", 1)[-1]


@pytest.mark.parametrize(("html", "markdown"), [
    ("<table><colgroup><col></colgroup><tr><td>a</td><td>b</td></tr></table>", "a\n\nb"),
    ("<table><tr><th>k</th></tr><tr><td>v</td></tr></table>", "| k |\n| --- |\n| v |"),
    ("<table><tr><td>left<table><thead><tr><td>k</td></tr></thead><tr><td>v</td></tr></table></td></tr></table>", "left\n\n| k |\n| --- |\n| v |"),
    ("<table><tr><th>k</th></tr><tr><td>x<table><tr><td>inner</td></tr></table></td></tr></table>", "| k |\n| --- |\n| x inner |"),
    ("<table><tr><td>nested <table><tr><td>layout</td></tr></table></td></tr></table>", "nested\n\nlayout"),
    ("<table><tr><th>a|b</th><th></th></tr><tr><td>1</td></tr></table>", "| a\\|b |  |\n| --- | --- |\n| 1 |  |"),
])
def test_tables(html, markdown):
    assert _body(html) == markdown


@pytest.mark.parametrize(("html", "there", "absent"), [
    ('<p>a<img src="x.png" alt="pic">b</p>', "a изображение: pic b", "!["), ('<p>a <img alt="pic"> b</p>', "a изображение: pic b", "  "), ('<p>a<img alt=" ">b</p>', "ab", "изображение"),
    ('<h2>Head<a href="#head">#</a></h2>', "## Head", "#head"), ('<h2>Head<a href="/dir/page#head"> ¶ </a></h2>', "## Head", "¶"), ('<p><a href="/other#head">#</a></p>', "[#](https://h.example/other#head)", "none"),
    ('<p><a href="#note">note 1</a></p>', "[note 1](https://h.example/dir/page#note)", "none"), ('<p><a href="/p?utm_source=a&id=1&fbclid=2">l</a></p>', "(https://h.example/p?id=1)", "utm_"), ('<p><a href="mailto:a@b.example">m</a></p>', "[m](mailto:a@b.example)", "none"),
    ("<p>in\u200bvis\u00adible</p>", "invisible", "\u200b"), ("<pre><code>a\u200bb</code></pre>", "a\u200bb", "none"), ("<p><code>x\u00ady</code></p>", "`x\u00ady`", "none"),
])
def test_sanitiser(html, there, absent):
    markdown = _body(html)
    assert there in markdown and absent not in markdown


@pytest.mark.parametrize(("attributes", "language"), [('class="language-py"', "py"), ('class="x lang-c++"', "c++"), ('class="brush: java; y"', "java"), ('class="highlight-source-shell"', "shell"), ("", "")])
def test_languages_and_fences(attributes, language):
    assert _body(f"<pre><code {attributes}>a\nb</code></pre>") == f"```{language}\na\nb\n```"
    assert _body(f"<pre><code {attributes}>````</code></pre>") == f"`````{language}\n````\n`````"
