import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import p1_encoding, p2_site_lines, p3_residue, p5_language, p6_main_content

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def sentences(spark):
    rows = spark.read.parquet(f"{DATA}/lang_samples.parquet").collect()
    return [(r.lang_code, r.sample_text) for r in rows]


# ---- problem 1


def _wrong(text, written, read):
    raw = text.encode(written)
    try:
        return raw.decode(read)
    except UnicodeDecodeError:
        return raw.decode("latin-1") if read == "cp1252" else None


@needs_data
def test_round_trips_are_found_and_undone(sentences):
    rng = random.Random(2)
    rng.shuffle(sentences)
    held, known = sentences[:60], sentences[60:]
    repairer = p1_encoding.Repairer(p1_encoding.train_costs(t for _, t in known))
    found = undone = total = 0
    for code, text in held:
        for written, read in [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437")] + ([("utf-8", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251")] if code in ("ru", "uk") else []):
            try:
                bad = _wrong(text, written, read)
            except UnicodeEncodeError:
                continue
            if bad is None or bad == text:
                continue
            total += 1
            fixed, layers = repairer.repair(bad)
            found += bool(layers)
            undone += fixed == text
    assert total > 150 and found / total > 0.97 and undone / total > 0.9, (found, undone, total)
    clean = [t for _, t in held if repairer.repair(t)[1]]
    assert not clean, clean


@needs_data
def test_nested_layers_and_partly_lost_text(sentences):
    repairer = p1_encoding.Repairer(p1_encoding.train_costs(t for _, t in sentences))
    once = "Die Preisliste prüft das Wetterblatt – für Gäste".encode().decode("cp1252")
    twice = once.encode().decode("cp1252")
    assert repairer.repair(twice) == ("Die Preisliste prüft das Wetterblatt – für Gäste", ["utf_8 read as cp1252"] * 2)
    assert p1_encoding.repair_title("Caf� terminal", repairer)[2] is False
    assert p1_encoding.repair_title("The sample `Ã¼` in code", repairer) is None
    page = "<p>gut fÃ¼r GÃ¤ste</p><pre>Ã¼</pre><script>'Ã¼'</script>"
    assert p1_encoding.repair_html(page, repairer)[0] == "<p>gut für Gäste</p><pre>Ã¼</pre><script>'Ã¼'</script>"
    assert p1_encoding.repair_html("<pre>Ã¼</pre><p>ok</p>", repairer) is None


@needs_data
def test_garbled_fields_of_any_rows(spark):
    samples = spark.read.parquet(f"{DATA}/lang_samples.parquet")
    bad = "für die Gäste und für die Schlüssel".encode().decode("cp1252")
    pages = spark.createDataFrame([(1, f"<p>{bad}</p>", "t"), (1, f"<p>{bad}</p>", "t"), (2, None, None), (3, "", ""), (4, "<p>plain</p>", "row_id"), (5, "é" * 200_000, "")], "page_id bigint, html string, t string")
    titles = spark.createDataFrame([(1, None, "x"), (2, bad, "y")], "page_id bigint, title string, restored string")
    out = p1_encoding.garbled_fields(pages, titles, samples)
    assert sorted((r.page_id, r.field_name) for r in out.collect()) == [(1, "html"), (2, "title")]
    assert p1_encoding.garbled_fields(pages.where("false"), titles.where("false"), samples.where("false")).count() == 0


@needs_data
def test_garbling_written_as_character_references(spark, sentences):
    repairer = p1_encoding.Repairer(p1_encoding.train_costs(t for _, t in sentences))
    refer = lambda text: "".join(c if c < "\x80" else f"&#{ord(c)};" if k % 2 else f"&#x{ord(c):x};" for k, c in enumerate(text))
    for clean, read in (("Die Preisliste prüft das Wetterblatt – für Gäste", "cp1252"), ("для страниц и данных", "cp1251")):
        bad = refer(clean.encode().decode(read))
        assert bad.isascii()
        assert p1_encoding.repair_html(f"<p>{bad} &lt;b&gt; &amp;lt; R&D</p><p>x &#x27;y&#x27;</p>", repairer)[0] == f"<p>{clean} &lt;b&gt; &amp;lt; R&amp;D</p><p>x &#x27;y&#x27;</p>"
        assert p1_encoding.repair_html(f"<p>{refer(clean)} &copy; &nbsp; a &amp; b &#0;</p><code>{bad}</code>", repairer) is None
    assert p1_encoding.repair_html("<p>It isn&#226;&#128;&#x99;t the cache</p>", repairer)[0] == "<p>It isn’t the cache</p>"
    assert p1_encoding.repair_html("<p>Caf&#xFFFD; terminal</p>", repairer)[2] is False
    pages = spark.createDataFrame([(1, f"<p>{bad}</p>"), (2, "<p>a &amp; b</p>"), (3, "<p>plain</p>"), (4, "<p>&copy; caf&eacute;</p>")], "page_id bigint, html string")
    titles = spark.createDataFrame([], "page_id bigint, title string")
    samples = spark.read.parquet(f"{DATA}/lang_samples.parquet")
    assert [(r.page_id, r.restored) for r in p1_encoding.garbled_fields(pages, titles, samples).collect()] == [(1, f"<p>{clean}</p>")]


@needs_data
def test_titles_with_code_samples_and_many_layers(sentences):
    repairer = p1_encoding.Repairer(p1_encoding.train_costs(t for _, t in sentences))
    clean = "Die Preisliste prüft das Wetterblatt – für Gäste"
    bad = clean.encode().decode("cp1252")
    assert p1_encoding.repair_title(f"{bad} `Ã¼`\f``é``und {bad}", repairer) == (f"{clean} `Ã¼`\f``é``und {clean}", ["utf_8 read as cp1252"], True)
    deep = clean
    for _ in range(6):
        deep = deep.encode().decode("latin-1")
    text, layers, whole = p1_encoding.repair_title(deep, repairer)
    assert text == clean and len(layers) == 6 and whole


# ---- problem 2

SCRAPES = "scrape_id bigint, url string, title string, markdown string, site string, line string"


def _scrapes(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCRAPES)


def test_lines_of_a_site(spark):
    rows = [(k, f"https://WWW.h.example:443/p{k}/?q={k}#f", "t", f"Own words number {chr(97 + k)}\n\n** Share THIS page! ({k}) **\n---\n© {k}") for k in range(10)]
    rows += [(100 + k, f"http://h.example/p{k}", "t", "share, this: page") for k in range(2)]  # other spellings of known pages
    rows += [(200, None, "t", "Share this page"), (201, "about:blank", "t", "Share this page"), (202, "https://h.example/p99", "t", None), (203, "https://other.example/", "t", "Share this page")]
    found = p2_site_lines.repeated_lines(_scrapes(spark, rows + rows[:3]))
    got = sorted((r.scrape_id, r.line_no, r.pages, r.site_pages) for r in found.collect())
    assert got == sorted([(k, 3, 10, 11) for k in range(10)] + [(100, 1, 10, 11), (101, 1, 10, 11)])
    cleaned = p2_site_lines.without_lines(_scrapes(spark, rows), found)
    texts = {r.scrape_id: (r.markdown, r.removed_lines) for r in cleaned.collect()}
    assert texts[0] == ("Own words number a\n\n---\n© 0", 1) and texts[202] == (None, 0) and texts[203] == ("Share this page", 0) and texts[100] == ("", 1)
    clashing = _scrapes(spark, rows).selectExpr("*", "1 as removed_lines", "2 as line_no", "3 as _id", "4 as _drop")
    assert p2_site_lines.without_lines(clashing, found).where("removed_lines = 1").count() == 12
    assert p2_site_lines.repeated_lines(_scrapes(spark, rows).where("false")).count() == 0


def test_thresholds_of_lines(spark):
    rows = [(k, f"https://h.example/{k}", "t", "Seen often" if k < 8 else "Own " + chr(97 + k % 26) * (k % 7 + 1)) for k in range(32)]
    assert p2_site_lines.repeated_lines(_scrapes(spark, rows)).count() == 8
    assert p2_site_lines.repeated_lines(_scrapes(spark, [*rows, (40, "https://h.example/40", "t", None)])).count() == 0  # under a quarter
    assert p2_site_lines.repeated_lines(_scrapes(spark, rows[1:])).count() == 0  # seven pages


def test_containers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4_096, 4_097, 40_000):
        a, b = (np.unique(rng.integers(0, 1 << 16, n)) for _ in range(2))
        assert (p2_site_lines.unpack(p2_site_lines.pack(a)) == a).all()
        both = p2_site_lines.unite([p2_site_lines.pack(a), p2_site_lines.pack(b)])
        assert (p2_site_lines.unpack(both) == np.union1d(a, b)).all()


# ---- problem 3


def test_lines_are_deleted_by_the_bits_of_their_bitmaps(spark):
    rows = [(k, f"https://h.example/{k}", "t", f"Terms of use\nown words of {chr(97 + k) * 3}") for k in range(12)]
    occurrences, bitmaps = p2_site_lines.line_bitmaps(_scrapes(spark, rows))
    held = bitmaps.collect()
    assert len(held) == 1 and held[0].few == list(range(12)) and held[0].words is None
    assert {r.scrape_id for r in p2_site_lines.look_up(occurrences, bitmaps).collect()} == set(range(12))
    ordinal = {r.scrape_id: r.ordinal for r in occurrences.collect()}
    without = bitmaps.withColumn("few", F.array_remove("few", ordinal[5]))
    assert {r.scrape_id for r in p2_site_lines.look_up(occurrences, without).collect()} == set(range(12)) - {5}
    bits = p2_site_lines.opened(b"B" + np.packbits(np.isin(np.arange(1 << 16), [o for k, o in ordinal.items() if k != 7]), bitorder="little").tobytes())[1]
    dense = bitmaps.withColumn("few", F.lit(None).cast("array<int>")).withColumn("words", F.lit(bits).cast("array<bigint>"))
    assert {r.scrape_id for r in p2_site_lines.look_up(occurrences, dense).collect()} == set(range(12)) - {7}



def test_residue(spark):
    words = "The harbour office counts the boats that came in over the night and writes their names into the old book. " * 4
    pages = [
        (1, "https://h.example/1", "<title>Page not found</title><nav>Home</nav><h1>Page not found</h1><p>Please try again in 5 minutes.</p><ul><li><a href=/p/1>Some other story</a></ul>", 200),
        (2, "https://h.example/2", f"<p>{words}</p><p>Dear {{{{first_name}}}}, hello</p>", 200),
        (3, "https://h.example/3", f"<p>{words}</p><pre>{{{{name}}}}</pre><p>Write <code>[[x]]</code>.</p><!-- ${{y}} --><div hidden>%%z%%</div>", 200),
        (4, "https://h.example/4", "<title>App</title><div id=app></div><noscript>You need to enable JavaScript to run this app.</noscript><script>x()</script>", 200),
        (5, "https://h.example/5", f"<p>{words}</p><noscript>You need to enable JavaScript to run this app.</noscript>", 200),
        (6, "https://h.example/6", f"<p>{words}</p>", 404),
        (7, "https://h.example/7", "<h1>T</h1><p>Lorem ipsum dolor sit amet, consectetur adipiscing elit.</p>", 200),
        (8, None, None, None), (9, "x", "  ", 200),
    ]
    scrapes = [
        (1, "https://h.example/1", "T", "# Доступ запрещён\n\nКод обращения 5."), (2, "https://h.example/2", "T", words + "\n\nThe page said: \"Page not found\", and nobody knew why it had gone."),
        (3, "https://h.example/3", "T", "# T\n\nfoo bar asdf foo blah test qwer zxcv"), (4, None, "{{title}}", words), (5, "https://h.example/5", "T", f"```\n{{{{x}}}}\n```\n\n{words} `{{y}}`"), (6, None, None, None), (7, "h", "T", ""), (8, "https://h.example/8", "T", "```\nFatal TypeError in /srv/a/view.x on line 5\n  at render (5:2)\n```"),
    ]
    p = spark.createDataFrame([(*r, "k") for r in pages], "page_id bigint, url string, html string, status int, key string")
    s = spark.createDataFrame([(*r, 1) for r in scrapes], "scrape_id bigint, url string, title string, markdown string, kind int")
    out = p3_residue.find_residue(p.unionByName(p), s)
    got = sorted((r.record_table, r.record_id, r.reason) for r in out.collect())
    assert got == [("pages", 1, "error"), ("pages", 2, "placeholder"), ("pages", 4, "script"), ("pages", 7, "filler"), ("scrapes", 1, "error"), ("scrapes", 3, "filler"), ("scrapes", 4, "placeholder"), ("scrapes", 8, "error")]
    assert p3_residue.find_residue(p.where("false"), s.where("false")).count() == 0


def test_boilerplate_of_a_host_is_no_content(spark):
    footer = "Every one of our many pages says these same words at its very end because the people who made it wanted them there for all of the readers who ever come by, and so they stay there for good and for all"
    rows = [(k, f"https://h.example/{k}", "T", ("# Service unavailable\n\n" if k == 0 else f"A story {chr(97 + k)} of its own. " * 12 + "\n\n") + footer) for k in range(12)]
    s = spark.createDataFrame(rows, "scrape_id bigint, url string, title string, markdown string")
    p = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert [(r.record_id, r.reason) for r in p3_residue.find_residue(p, s).collect()] == [(0, "error")]


def test_filler_after_other_words():
    dummy = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim"
    assert p3_residue.kind_of(f"Here is some sample copy: {dummy}.") == p3_residue.FILLER
    assert p3_residue.kind_of(f"Here is some sample copy of what they mean when they write that {dummy[:40]}") == p3_residue.NOTHING
    assert p3_residue.kind_of("The office counts the boats of this harbour, as it always did") == p3_residue.NOTHING


def test_records_delivered_twice_count_once(spark):
    words = " ".join(f"word{chr(97 + k)}" for k in range(25))  # 50 if both copies counted
    rows = [(1, "https://a.example/1", "T", f"# Service unavailable\n\n{words}")]
    shared = " ".join(f"shared{chr(97 + k)}" for k in range(22)) + " " + " ".join(f"line{chr(97 + k)}" for k in range(22))
    rows += [(10 + k, f"https://b.example/{k}", "T", ("# Service unavailable\n\n" if k == 0 else "") + shared) for k in range(3)]  # in three records, not in six
    s = spark.createDataFrame(rows + rows, "scrape_id bigint, url string, title string, markdown string")
    html = [(1, "https://c.example/1", f"<h1>Page not found</h1><p>{words}</p>")]
    p = spark.createDataFrame(html + html, "page_id bigint, url string, html string")
    got = sorted((r.record_table, r.record_id, r.reason, r.content_words) for r in p3_residue.find_residue(p, s).collect())
    assert got == [("pages", 1, "error", 25), ("scrapes", 1, "error", 25)]


# ---- problem 5


@needs_data
def test_network_on_held_out_sentences(sentences):
    rng = random.Random(4)
    rng.shuffle(sentences)
    net = p5_language.train(sentences[50:])
    held = sentences[:50]
    chances = p5_language.line_probabilities(net, [t for _, t in held])
    right = [net.codes[k] == code for k, (code, _) in zip(chances.argmax(axis=1), held)]
    assert np.mean(right) >= 0.92
    pairs = [" ".join(t for c, t in held if c == code) for code in net.codes]  # long texts: all of a language
    chances = p5_language.line_probabilities(net, pairs)
    assert [net.codes[k] for k in chances.argmax(axis=1)] == net.codes
    assert np.allclose(chances.sum(axis=1), 1, atol=1e-4)


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    h = p5_language.HIDDEN
    draw = lambda *s: (rng.standard_normal(s) * 0.4).astype(np.float64)
    net = p5_language.Network(["a", "b"], draw(2, 2, 256, 3 * h), draw(2, h, 3 * h), draw(2, 3 * h), draw(2 * h, 2), draw(2))
    steps, labels, weight = rng.integers(0, 256, (5, 3, 2)), rng.integers(0, 2, (5, 3)), np.ones((5, 3))

    def loss():
        p = p5_language._outputs(net, p5_language._read(net, steps).astype(np.float64))
        return -np.log(np.take_along_axis(p, labels[:, :, None], 2)).mean()

    grads = p5_language._gradients(net, steps, labels, weight)
    for w, g in zip(net.weights(), grads):
        for _ in range(4):
            at = np.unravel_index(np.abs(g).argmax(), g.shape) if _ == 0 else tuple(rng.integers(0, s) for s in w.shape)
            keep = w[at]
            w[at] = keep + 1e-3
            up = loss()
            w[at] = keep - 1e-3
            down = loss()
            w[at] = keep
            assert abs((up - down) / 2e-3 - g[at]) < 2e-3, at


@needs_data
def test_wrong_labels(spark, sentences):
    samples = spark.read.parquet(f"{DATA}/lang_samples.parquet")
    by = {c: [t for k, t in sentences if k == c] for c in ("en", "de", "ru")}
    long = lambda c, a: " ".join(by[c][a : a + 4])
    rows = [(1, long("en", 0), ("en_GB",)), (2, long("de", 0), ("English",)), (3, long("en", 4) + "\n\n" + long("ru", 0), ("en",)), (4, long("ru", 4), None), (5, long("de", 4), (" ",)), (6, "kurz", ("xx",)), (7, None, ("en",)), (8, " ", None), (9, "```\n" + long("ru", 8) + "\n```\n" + long("en", 8), ("english",)), (10, long("de", 8) * 40, ("deutsch",))]
    df = spark.createDataFrame([(k, m, t, "x") for k, m, t in rows + rows[:3]], "page_id bigint, markdown string, meta struct<lang:string>, lang_code string")
    out = p5_language.wrong_labels(df, samples)
    assert sorted((r.page_id, r.lang_code) for r in out.collect()) == [(2, "de"), (3, "en"), (3, "ru"), (4, "ru"), (5, "de")]
    assert p5_language.wrong_labels(df.where("false"), samples).count() == 0


@needs_data
def test_segments(spark, sentences):
    samples = spark.read.parquet(f"{DATA}/lang_samples.parquet")
    by = {c: " ".join(t for k, t in sentences if k == c)[:400] for c in ("en", "ru", "ja")}
    df = spark.createDataFrame([(1, by["en"] + "\n\nOk\n" + by["ru"] + "\n" + by["ru"] + "\n- 7\n" + by["en"]), (2, by["ja"]), (3, ""), (4, None)], "page_id bigint, markdown string")
    lines = p5_language.label_lines(df, samples)
    got = sorted((r.row_id, r.segment_no, r.first_line, r.last_line, r.lang_code) for r in p5_language.language_segments(lines).collect())
    assert got == [(1, 1, 1, 3, "en"), (1, 2, 4, 5, "ru"), (1, 3, 7, 7, "en"), (2, 1, 1, 1, "ja")]
    labels = {r.row_id: (r.lang_code, r.confidence > 0.8) for r in p5_language.document_labels(p5_language.language_segments(lines)).collect()}
    assert labels == {1: ("ru", True), 2: ("ja", True)}


def test_language_codes():
    names = {"en-US": "en", "EN_gb": "en", "Deutsch": "de", " ru ": "ru", "русский": "ru", "日本語": "ja", "xx": None, "": None, None: None, "utf-8": None, "uk": "uk", "0": None}
    assert {k: p5_language.language_code(k) for k in names} == names


# ---- problem 6


def test_messages_against_enumeration():
    import itertools
    import math

    rng = random.Random(6)
    for _ in range(20):
        n = rng.randint(1, 7)
        parents = [-1] + [rng.randrange(k) for k in range(1, n)]
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        ties = [((rng.uniform(0.2, 2), rng.uniform(0.2, 2)), (rng.uniform(0.2, 2), rng.uniform(0.2, 2))) for _ in range(n)]
        mass = [[0.0, 0.0] for _ in range(n)]
        for labels in itertools.product((0, 1), repeat=n):
            p = 1.0
            for k in range(n):
                q = 1 / (1 + math.exp(-odds[k]))
                p *= (q if labels[k] else 1 - q) * (ties[k][labels[parents[k]]][labels[k]] if k else 1)
            for k in range(n):
                mass[k][labels[k]] += p
        wanted = [m[1] / sum(m) for m in mass]
        assert np.allclose(p6_main_content.sum_product(parents, odds, ties), wanted)


@needs_data
def test_held_out_pages(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").distinct().collect() if r.html and "<article>" in r.html]
    model = p6_main_content.train(pages[: len(pages) // 2])
    hashes, good, total = p6_main_content.Hashes(), 0, 0
    for html in pages[len(pages) // 2 :]:
        blocks = p6_main_content.parse(html)
        labels = p6_main_content.own_label(blocks)
        wanted = {"".join(b.text).strip(): label for b, label in zip(blocks, labels) if b.size and label >= 0}
        bare = html  # the same page without the marks that label it
        for tag in ("article", "main", "nav", "header", "footer", "aside", "form"):
            bare = bare.replace(f"<{tag}", "<div").replace(f"</{tag}", "</div")
        bare = p6_main_content.re.sub(r'<div (class|id)="[^"]*"', "<div", bare)
        for text, chance, _ in p6_main_content.block_marginals(bare, model, hashes):
            if text in wanted:
                total += 1
                good += (chance >= 0.5) == bool(wanted[text])
    assert total > 1_000 and good / total > 0.95, (good, total)


def test_content_of_any_rows(spark):
    page = "<nav><ul><li><a href=/1>Home</a><li><a href=/2>Shop</a></ul></nav><article><h1>Title</h1><p>The harbour office counts the boats, and nothing else changes.</p></article><footer>© 2024 Us. All rights reserved.</footer>"
    text = "[Home](/1) [Shop](/2)\n\n# Title\n\nThe harbour office counts the boats, and nothing else changes.\n\n© 2024 Us. All rights reserved."
    pages = spark.createDataFrame([(k, page.replace("boats", f"boats {k}"), "x") for k in range(30)] + [(40, None, "x"), (1, page.replace("boats", "boats 1"), "x")], "page_id bigint, html string, line string")
    texts = spark.createDataFrame([(k, text.replace("boats", f"boats {k}"), 1) for k in range(5)] + [(40, text, 1), (41, text, 1), (42, None, 1), (43, " ", 1), (None, text, 1), (44, "word " * 60_000, 1)], "page_id bigint, markdown string, content int")
    out = p6_main_content.label_content(texts.unionByName(texts), pages)
    got = {(r.page_id, r.line_no): r.content for r in out.collect()}
    for k in (0, 1, 2, 3, 4, 40, 41):
        assert [n for i, n in sorted(got) if i == k] == [1, 3, 5, 7]
    for k in range(5):
        assert got[k, 1] < 0.5 and got[k, 7] < 0.5 and got[k, 3] > 0.5 and got[k, 5] > 0.5
    assert not any(i in (42, 43) for i, _ in got)
    bodies = {r.page_id: r.body for r in p6_main_content.main_body(out).collect()}
    assert bodies[0].startswith("# Title\nThe harbour")
    assert p6_main_content.label_content(texts.where("false"), pages).count() == 0


def test_words_in_the_middle_of_long_lines():
    rng = random.Random(8)
    draw = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    neutral, story, notice = "one two three four five six seven".split(), "harbour boat fisher tide quay net sailor".split(), "cookies consent accept partners privacy settings decline".split()
    line = lambda words: f"{draw(neutral, 8)} {draw(words, 24)} {draw(neutral, 8)}."
    model = p6_main_content.train([f"<article><p>{line(story)}</p></article><footer><p>{line(notice)}</p></footer>" for _ in range(60)])
    hashes = p6_main_content.Hashes()
    start, end = draw(neutral, 8), draw(neutral, 8)
    chance = lambda words: p6_main_content.line_marginals(f"{start} {draw(words, 24)} {end}.", None, model, hashes)[0][1]
    assert chance(story) > 0.7 and chance(notice) < 0.3
    for words in (story, notice):  # every word and every bigram of a long text counts
        text = f"{start} {draw(words, 24)} {end}"
        split = text.split()
        index, shares = p6_main_content.text_features(text, 0, 0, 0, "p", hashes)
        assert {hashes["w:" + w] for w in split} | {hashes[f"b:{a} {b}"] for a, b in zip(split, split[1:])} <= set(index) and len(index) == len(shares)
