"""Every registered query of the core with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import classify, text, urls
from tessera.functions.html import extract_pages
from tessera.operators import actions, cache, errors, fetch, outline, pacing, search, validation
from tessera.plans import pipelines, sql
from tessera.plans.api import Engine
from tessera.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(run: Query) -> Query:
        _QUERIES[run.__name__] = run
        if oracle:
            _SQL[run.__name__] = oracle
        return run

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rows(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _values(*rows: tuple) -> str:
    """The same rows as an SQL list."""

    def one(v: object) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return "(values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def classified_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: the first page of each address with its verdict."""
    pages = fetch.latest_page(table(spark, folder, "pages")).withColumn("html", F.coalesce("html", F.lit("")))
    first = pages.withColumn("key", urls.dedupe_key(F.col("url")))
    first = first.withColumn("_rn", F.row_number().over(Window.partitionBy("key").orderBy("page_id"))).where("_rn = 1")
    rows = fetch.verdicts(first)
    return rows.select("page_id", "key", "scripts", "visible", "wall", "reason")


# ---- addresses

_URLS = (("HTTPS://Example.COM:443/a/?b=2&a=1&utm_source=x#f",), ("http://h.example:8080/",), ("https://e.example/x/?b=1&a=2&a=0&b=0",), ("https://e.example",), ("http://e.example:80/p/?gclid=1&si=2",), ("nope",), ("https://e.example/?ref=1&REF_SRC=2",))


_NORMAL = f"coalesce({sql.normalised('url')}, case when url like 'about:%' then url end)"


@_query(f"select distinct url, {_NORMAL} as normalized from (select url from pages union all select url from scrapes union all select * from {_values(*_URLS)} t(url))")
def normalize_url(spark: SparkSession, folder: str) -> DataFrame:
    both = table(spark, folder, "pages").select("url").unionByName(table(spark, folder, "scrapes").select("url")).unionByName(_rows(spark, "url string", *_URLS))
    return both.distinct().select("url", urls.normalize_url(F.col("url")).alias("normalized"))


@_query(f"select distinct scrape_id, sha256('scrape:' || {_NORMAL} || ':false') as scrape_key from scrapes")
def scrape_key(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "scrapes").select("scrape_id", "url").distinct()
    key = F.when(urls.normalize_url(F.col("url")).isNotNull(), urls.scrape_key(F.col("url")))
    return rows.select("scrape_id", key.alias("scrape_key"))


@_query(f"select {sql.host('url')} as host, count(*) as n_requests, count(distinct {sql.normalised('url')}) as n_pages from requests group by 1")
def url_host(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "requests").select(urls.url_host(F.col("url")).alias("host"), urls.normalize_url(F.col("url")).alias("page"))
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_requests"), F.countDistinct("page").alias("n_pages"))


_ADDRESSES = tuple((a,) for a in "127.0.0.1 10.1.2.3 172.15.0.1 172.16.0.1 172.31.9.9 172.32.0.1 192.168.1.1 192.169.1.1 169.254.1.1 100.63.0.1 100.64.0.1 100.128.0.1 8.8.8.8 0.0.0.0 224.0.0.1 255.255.255.255 1.2.3".split())
_SIX = (("::1", True), ("::", True), ("fc00::1", True), ("fd12::", True), ("fe80::1", True), ("febf::1", True), ("fec0::1", False), ("::ffff:10.0.0.1", True), ("::ffff:8.8.8.8", False), ("::ffff:0a00:0001", True), ("::ffff:808:808", False), ("2001:db8::1", False), ("nope", True), ("1:2:3", True))


@_query(f"""select ip, case when not regexp_matches(ip, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') then true else a in (0, 10, 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 100 and b between 64 and 127) or a >= 224 end as is_private
from (select ip, try_cast(split_part(ip, '.', 1) as int) as a, try_cast(split_part(ip, '.', 2) as int) as b from {_values(*_ADDRESSES)} t(ip))""")
def private_ipv4(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, "ip string", *_ADDRESSES).select("ip", urls.is_private_address(F.col("ip")).alias("is_private"))


@_query(f"select * from {_values(*_SIX)} t(ip, is_private)")
def private_ipv6(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, "ip string", *((a,) for a, _ in _SIX)).select("ip", urls.is_private_address(F.col("ip")).alias("is_private"))


_FORBIDDEN = ("ftp://x.example/", "file:///etc/passwd", "http://localhost/", "http://localhost./", "http://a.local/", "http://a.internal/", "http://b.home.arpa/", "http://127.0.0.1/", "http://10.0.0.8/", "http://[::1]/", "http://169.254.169.254/latest", "nope", "")


_REFUSED = lambda u: f"case when {sql.scheme(u)} in ('http', 'https') and {sql.host(u)} is not null and not regexp_matches({sql.host(u)}, '^localhost\\.?$|\\.(local|localhost|internal|home\\.arpa)\\.?$|^(127|10|169\\.254)\\.|^\\[') then null else 'invalid_url' end"


@_query(f"""select url, case when {sql.scheme('url')} in ('http', 'https') and {sql.host('url')} is not null and not regexp_matches({sql.host('url')}, '^localhost\\.?$|\\.(local|localhost|internal|home\\.arpa)\\.?$|^(127|10|169\\.254)\\.|^\\[') then null else 'invalid_url' end as error
from (select distinct url from scrapes where url is not null union select * from {_values(*((u,) for u in _FORBIDDEN))} t(url))""")
def allowed_url(spark: SparkSession, folder: str) -> DataFrame:
    both = table(spark, folder, "scrapes").select("url").where("url is not null").unionByName(_rows(spark, "url string", *((u,) for u in _FORBIDDEN))).distinct()
    return both.select("url", urls.url_error(F.col("url")).alias("error"))


_RESOLVED = (("docs.brennwick.example", "10.0.0.1"), ("docs.brennwick.example", "93.184.216.34"), ("sorwenithak.example", "93.184.216.34"))


@_query(f"""select r.host, case when d.host is null then 'network' when d.private then 'invalid_url' end as host_error from (select distinct host from requests where host is not null) r
left join (select host, bool_or(address like '10.%') as private from {_values(*_RESOLVED)} t(host, address) group by host) d on lower(r.host) = d.host""")
def public_host(spark: SparkSession, folder: str) -> DataFrame:
    hosts = table(spark, folder, "requests").select("host").where("host is not null").distinct()
    return fetch.public_hosts(hosts, _rows(spark, "host string, address string", *_RESOLVED))


_TRACK = "regexp_matches(lower(split_part(p, '=', 1)), '^(utm_|(fbclid|gclid|msclkid|yclid|mc_cid|mc_eid|igshid)$)')"
_CLEANED = f"""case when list_count(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' and {_TRACK})) = 0 then url
else regexp_extract(url, '^([^?#]*)', 1) || (case when array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' and not {_TRACK}), '&') = '' then '' else '?' || array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' and not {_TRACK}), '&') end) || regexp_extract(url, '(#.*)$', 1) end"""


@_query(f"select distinct url, {_CLEANED} as cleaned from scrapes where url is not null")
def tracking_links(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "scrapes").select("url").where("url is not null").distinct().select("url", urls.strip_tracking(F.col("url")).alias("cleaned"))


@_query(f"""select page_id, pos, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href else {sql.scheme('url')} || '://' || {sql.host('url')} || href end as resolved
from (select distinct e.page_id, u.pos, u.href, p.url from extracted e join (select page_id, any_value(url) as url from pages group by page_id) p on e.page_id = p.page_id, lateral (select unnest(range(len(e.links))) as pos, unnest(e.links).href as href) u where u.href like '/%' or u.href like 'http%://%/%')""")
def resolved_links(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url").dropDuplicates(["page_id"])
    links = table(spark, folder, "extracted").select("page_id", F.posexplode("links").alias("pos", "l")).select("page_id", "pos", F.col("l.href").alias("href")).distinct()
    links = links.where("href like '/%' or href like 'http%://%/%'").join(pages, "page_id")
    return links.select("page_id", F.col("pos").cast("bigint").alias("pos"), urls.resolve_url(F.col("href"), F.col("url")).alias("resolved"))


_HARD = ("x", "../x", "./y/../z", "?q=1", "#f", "mailto:a@b.example", "//other.example/p", "/a/./b/../c", "")
_URL_PATH = "coalesce(nullif(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*:/*[^/?#]*([^?#]*)', 1), ''), '/')"
_URL_DIR = f"regexp_replace({_URL_PATH}, '[^/]*$', '')"
_URL_QUERY = "regexp_extract(trim(url), '^[^?#]*(\\?[^#]*)', 1)"


@_query(f"""select url, href, case href when 'x' then {sql.origin('url')} || {_URL_DIR} || 'x' when '../x' then {sql.origin('url')} || regexp_replace({_URL_DIR}, '[^/]+/$', '') || 'x' when './y/../z' then {sql.origin('url')} || {_URL_DIR} || 'z' when '?q=1' then {sql.origin('url')} || {_URL_PATH} || '?q=1'
when '#f' then {sql.origin('url')} || {_URL_PATH} || {_URL_QUERY} || '#f' when '//other.example/p' then {sql.scheme('url')} || ':' || href when '/a/./b/../c' then {sql.origin('url')} || '/a/c' when '' then {sql.origin('url')} || {_URL_PATH} || {_URL_QUERY} else href end as resolved
from (select url, unnest([{', '.join(repr(h) for h in _HARD)}]) as href from (select distinct url from pages where url is not null))""")
def hard_links(spark: SparkSession, folder: str) -> DataFrame:
    """Relative addresses of every kind, seen from every page."""
    pages = table(spark, folder, "pages").select("url").where("url is not null").distinct()
    rows = pages.select("url", F.explode(F.array(*map(F.lit, _HARD))).alias("href"))
    return rows.select("url", "href", urls.resolve_url(F.col("href"), F.col("url")).alias("resolved"))


# ---- pages

_PAGES = "(select distinct page_id, url, coalesce(html, '') as html, status, content_type from pages)"


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pages").select("page_id", "url", "html", "status", "content_type").distinct()
    return rows.withColumn("html", F.coalesce("html", F.lit("")))


_FIRST = f"(select page_id, url, coalesce(html, '') as html from pages qualify row_number() over (partition by coalesce({sql.normalised('url')}, url) order by page_id, landed_at desc) = 1)"


@_query(f"select page_id, coalesce({sql.normalised('url')}, url) as page_key from {_FIRST}")
def dedupe_pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pages").select("page_id", "url").distinct().withColumn("page_key", urls.dedupe_key(F.col("url")))
    order = Window.partitionBy("page_key").orderBy("page_id")
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("page_id", "page_key")


@_query(f"select page_id, {sql.script_length('html')} as script_length, length({sql.visible_text('html')}) as visible_length, length({sql.markup_only('html')}) as markup_length from {_PAGES}")
def page_measures(spark: SparkSession, folder: str) -> DataFrame:
    h = F.col("html")
    return _pages(spark, folder).select("page_id", classify.script_length(h).cast("bigint").alias("script_length"), classify.visible_text_length(h).cast("bigint").alias("visible_length"), F.length(classify.markup_only(h)).cast("bigint").alias("markup_length"))


_SHELL = lambda scripts, words: "<html><body><p>" + "w" * words + "</p><script>" + "s" * (scripts - 17) + "</script></body></html>"
_CASES = (
    (1, 200, "text/html", _SHELL(48_000, 1_199)), (2, 200, "text/html", _SHELL(48_000, 1_200)), (3, 200, "text/html", _SHELL(39 * 500, 500)), (4, 200, "text/html", _SHELL(41 * 500, 500)),
    (5, 200, "text/html", _SHELL(79 * 1_300, 1_300)), (6, 200, "text/html", _SHELL(81 * 1_300, 1_300)), (7, 403, "text/html", _SHELL(17, 300)), (8, 404, "text/html", _SHELL(17, 300)),
    (9, 200, "application/pdf", "x"), (10, 200, None, "<body></body>"), (11, 200, "text/html", "<body><script>x</script></body>"), (12, 200, "application/json", "{}"),
    (13, 200, "text/html", "<script>window._cf_chl_opt={}</script><p>wait</p>"), (14, 200, "text/html", "<title>Just a moment...</title>"), (15, 200, "text/html", "<p>Just a moment, about cf-turnstile</p>"),
    (16, 200, "text/html", "<div class='cf-turnstile'></div>form"), (17, 200, "text/html", "<script src='https://js.datadome.co/t.js'></script>x"), (18, 200, "text/html", "<div id=\"px-captcha\"></div>"),
    (19, 200, "text/html", "<script>document.cookie='_abck=1'</script>y"), (20, 200, "text/html", "<script src='/cdn-cgi/challenge-platform/h/g/scripts/jsd/1/main.js'></script>" + "w" * 50),
    (21, 200, "text/html", "<script src='/cdn-cgi/challenge-platform/h/g/orchestrate/chl_page/v1'></script>"), (22, 503, "TEXT/HTML", "down"), (23, 200, "image/svg+xml", "<svg>t</svg>"),
)


def _walls(m: str) -> str:
    parts = " ".join("when regexp_matches(" + m + ", '(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + f"') then '{name}'" for name, patterns in classify.WALLS.items())
    return f"(case {parts} end)"


_TEXTUAL = "(content_type is null or content_type = '' or regexp_matches(lower(content_type), 'text/html|application/xhtml|text/plain|\\+xml'))"
_JUDGED = f"""(select id, status, content_type, extracted, {_walls(sql.markup_only('html'))} as wall, {sql.script_length('html')} as scripts, length({sql.visible_text('html')}) as visible
from (select p.page_id as id, p.status, p.content_type, p.html, coalesce(e.text_length, 0) as extracted from {_PAGES} p left join (select page_id, any_value(text_length) as text_length from extracted group by page_id) e on p.page_id = e.page_id
union all select -id, status, content_type, html, 0 from {_values(*_CASES)} t(id, status, content_type, html)))"""


@_query(f"""select id, wall, case when not {_TEXTUAL} then 'content_type' when wall is not null then 'challenge' when status in (403, 429, 503) then 'status' when visible = 0 then (case when scripts > 0 then 'thin_spa' else 'empty_body' end)
when scripts / greatest(extracted, visible) > 80 then 'thin_spa' when greatest(extracted, visible) < 1200 and scripts / greatest(extracted, visible) > 40 then 'thin_spa' end as reason from {_JUDGED}""")
def page_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    lengths = table(spark, folder, "extracted").select("page_id", "text_length").distinct()
    rows = _pages(spark, folder).join(lengths, "page_id", "left").select(F.col("page_id").alias("id"), "status", "content_type", "html", "text_length")
    cases = _rows(spark, "id bigint, status int, content_type string, html string", *_CASES).withColumn("id", -F.col("id")).withColumn("text_length", F.lit(0))
    return fetch.verdicts(rows.unionByName(cases), "text_length").select("id", "wall", "reason")


_LIVE = ((1, "<div id=\"challenge-running\"></div>", True), (2, "<title>Checking your browser</title>", True), (3, "<div class=\"cf-turnstile\"></div><p>form</p>", False), (4, "<p>just a moment</p>", False), (5, "<form id='challenge-form'>", True))


@_query(f"select id, live from {_values(*_LIVE)} t(id, html, live)")
def live_walls(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, "id int, html string", *((i, h) for i, h, _ in _LIVE)).select("id", classify.live_wall(F.col("html")).alias("live"))


_HEAD = lambda p: f"nullif({sql.trim_all(sql.visible(sql.unescaped(f'regexp_extract(html, {p}, 1)')))}, '')"


@_query(f"""select page_id, coalesce({_HEAD("'(?is)<title[^>]*>(.*?)</title>'")}, {_HEAD("'(?is)<h1[^>]*>(.*?)</h1>'")}, '') as title, coalesce({_HEAD("'(?is)<meta property=.og:description. content=.([^\\x22]*)'")}, {_HEAD("'(?is)<meta name=.description. content=.([^\\x22]*)'")}) as description,
case when regexp_matches(html, '(?i)<html[^>]*\\blang="') then regexp_extract(html, '(?i)<html[^>]*\\blang="([^"]*)"', 1) end as lang from {_PAGES}""")
def extracted_heads(spark: SparkSession, folder: str) -> DataFrame:
    """What the extractor takes from the head of every page."""
    return extract_pages(_pages(spark, folder)).select("page_id", "doc.title", "doc.description", "doc.meta.lang")


@_query(f"""select page_id, row_number() over (partition by page_id order by nth) - 1 as pos, href, text from (select page_id, href, min(nth) as nth, arg_min(text, nth) as text from (
select page_id, nth, case when a[1] like '/%' then {sql.origin('url')} || a[1] else a[1] end as href, {sql.trim_all(sql.visible(sql.unescaped("regexp_replace(a[2], '<[^>]*>', '', 'g')")))}[:200] as text
from (select page_id, url, unnest(range(len(l))) as nth, [unnest(l), unnest(t)] as a from (select page_id, url, regexp_extract_all(html, '(?is)<a href="([^"]*)"[^>]*>(.*?)</a>', 1) as l, regexp_extract_all(html, '(?is)<a href="([^"]*)"[^>]*>(.*?)</a>', 2) as t from {_PAGES}))) group by page_id, href)""")
def extracted_links(spark: SparkSession, folder: str) -> DataFrame:
    """The links the extractor finds on every page: absolute, each once, in order, with their text."""
    links = extract_pages(_pages(spark, folder)).select("page_id", F.posexplode("doc.links").alias("pos", "l"))
    return links.select("page_id", F.col("pos").cast("bigint").alias("pos"), "l.href", "l.text")


#: A page around the words of a title: what the extractor must keep, and what it must not.
_COMPOSED = (
    '<html lang="en"><head><title> ', "w", ' </title><meta property="og:description" content=" "><meta name="description" content="About ', "w", '"><meta name="author" content="', "w", '"></head><body><nav><a href="/menu">Menu</a></nav><article><h2>', "w", '<a href="#s1">¶</a></h2><p>Text of <strong>', "w",
    '</strong> <img src="/i.png" alt="Photo"> and <a href="/p?utm_source=x&amp;id=7">more</a>.</p><img src="/no.png" alt=""><p>', "many", "</p><table><colgroup><col></colgroup><thead><tr><th>Name</th><th>Value</th></tr></thead><tbody><tr><td>", "w", "</td><td>7</td></tr></tbody></table><table><tr><td>layout ", "w",
    '</td></tr></table><pre><code class="language-py">x = "```"</code></pre><ul><li>one</li><li>two</li></ul><aside>Ad</aside></article><footer>foot <a href="/menu">Menu again</a></footer></body></html>',
)
_MARKED = (
    "## ", "w", "\n\nText of **", "w", "** изображение: Photo and [more](https://h.example/p?id=7).\n\n", "many", "\n\n| Name | Value |\n| --- | --- |\n| ", "w", " | 7 |\n\nlayout ", "w", '\n\n````py\nx = "```"\n````\n\n- one\n- two',
)
_MANY = "many more words of the same sort " * 12
_WORDS_SQL = "coalesce(nullif(trim(regexp_replace(title, '[^A-Za-z]+', ' ', 'g')), ''), 'Untitled')"


def _sql_text(parts: tuple[str, ...]) -> str:
    quoted = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return " || ".join("w" if p == "w" else quoted(_MANY.strip()) if p == "many" else quoted(p) for p in parts)


@_query(f"select page_id, w as title, 'About ' || w as description, w as author, 'en' as lang, 'https://h.example/menu https://h.example/p?id=7' as links, {_sql_text(_MARKED)} as markdown from (select distinct page_id, {_WORDS_SQL} as w from extracted)")
def composed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Pages composed around the words of every landed title, extracted: images, permalinks, tracking, tables, code, chrome."""
    words = F.coalesce(F.nullif(F.trim(F.regexp_replace("title", "[^A-Za-z]+", " ")), F.lit("")), F.lit("Untitled"))
    rows = table(spark, folder, "extracted").select("page_id", words.alias("w")).distinct()
    html = F.concat(*(F.col("w") if p == "w" else F.lit(_MANY.strip() if p == "many" else p) for p in _COMPOSED))
    docs = extract_pages(rows.select("page_id", F.lit("https://h.example/dir/page").alias("url"), html.alias("html")))
    return docs.select("page_id", "doc.title", "doc.description", "doc.meta.author", "doc.meta.lang", F.array_join(F.transform("doc.links", lambda x: x["href"]), " ").alias("links"), "doc.markdown")


@_query(f"""select case when grouping(host) = 0 then host end as host, case when grouping(via) = 0 then via end as via, grouping(host) + grouping(via) as level, count(*) as n_pages, sum(case when status >= 400 then 1 else 0 end) as n_errors
from (select distinct page_id, coalesce({sql.host('url')}, '') as host, coalesce(via, '') as via, status from pages) group by rollup (host, via)""")
def page_report(spark: SparkSession, folder: str) -> DataFrame:
    """Beyond the reference: pages and errors per host and way, with subtotals."""
    rows = table(spark, folder, "pages").select("page_id", F.coalesce(urls.url_host(F.col("url")), F.lit("")).alias("host"), F.coalesce("via", F.lit("")).alias("via"), "status").distinct()
    out = rows.rollup("host", "via").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.when(F.col("status") >= 400, 1).otherwise(0)).alias("n_errors"), (F.grouping("host").cast("int") + F.grouping("via").cast("int")).cast("bigint").alias("level"))
    return out.select("host", "via", "level", "n_pages", "n_errors")


@_query()
def extracted_pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pages").where(classify.is_textual(F.col("content_type"))).withColumn("html", F.coalesce("html", F.lit("")))
    return extract_pages(fetch.latest_page(rows)).select("page_id", "doc.title", "doc.description", "doc.markdown", "doc.text_length", F.size("doc.links").alias("n_links"), "doc.meta.lang")


@_query()
def fetched_pages(spark: SparkSession, folder: str) -> DataFrame:
    got = fetch.payloads(fetch.fetch(fetch.latest_page(table(spark, folder, "pages"))), include_links=True)
    return got.select("page_id", "url", "title", "via", "status", "error", F.length("markdown").alias("markdown_length"), F.size("links").alias("n_links"))


_CHAINS = ((1, "https://a.example/1 https://a.example/2 https://b.example/ https://A.example/3"), (2, "https://c.example/"))


@_query(f"select id, hosts from {_values((1, 'a.example,b.example'), (2, 'c.example'))} t(id, hosts)")
def redirect_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, "id int, chain string", *_CHAINS).select("id", F.array_join(fetch.queued_hops(F.split("chain", " ")), ",").alias("hosts"))


# ---- texts

_TEXTS = "(select distinct scrape_id, markdown from scrapes where markdown is not null)"


def _markdowns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "scrapes").select("scrape_id", "markdown").where("markdown is not null").distinct()


@_query(f"select scrape_id, sha256(t) as text_hash, length(markdown) > 1500 as truncated, case when length(markdown) > 1500 then length(markdown) - length(t) else 0 end as remaining from (select scrape_id, markdown, {sql.truncated('markdown', 1500)} as t from {_TEXTS})")
def truncate_markdown(spark: SparkSession, folder: str) -> DataFrame:
    cut = _markdowns(spark, folder).withColumn("c", text.truncate_markdown(F.col("markdown"), 1_500))
    return cut.select("scrape_id", F.sha2("c.text", 256).alias("text_hash"), F.col("c.truncated").alias("truncated"), F.col("c.remaining").cast("bigint").alias("remaining"))


@_query(f"select scrape_id, length({sql.plain_text('markdown')}) as plain_length, length({sql.trim_all(f'''regexp_replace(regexp_replace(markdown, '{chr(92)}n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[ {chr(92)}t]+$', '', 'g')''')}) as clean_length from {_TEXTS}")
def markdown_lengths(spark: SparkSession, folder: str) -> DataFrame:
    m = F.col("markdown")
    return _markdowns(spark, folder).select("scrape_id", text.plain_text_length(m).cast("bigint").alias("plain_length"), F.length(text.cleanup_markdown(m)).cast("bigint").alias("clean_length"))


_ODD = (("a" + chr(0xAD) + "b" + chr(0x200B) + "c" + chr(0xE001) + chr(0x200D) + "d",), ("x" + chr(0xA0) + chr(0xA0) + "y " + chr(0x202F) + "z" + chr(0xFEFF),), ("  p \t q  ",))
_CLEAN_SQL = sql.trim_all("regexp_replace(regexp_replace(regexp_replace(t, '[\\x{e000}-\\x{f8ff}]', '', 'g'), '( )[\\x{a0}\\x{202f}\\x{2007}\\x{feff}]+', '\\1', 'g'), '[\\x{a0}\\x{202f}\\x{2007}\\x{feff}]+', ' ', 'g')")


@_query(f"""select sha256(t) as id, {sql.units('t')} as units, sha256(regexp_replace(t, '[\\x{{ad}}\\x{{200b}}\\x{{2060}}\\x{{feff}}\\x{{e000}}-\\x{{f8ff}}]', '', 'g')) as visible_hash, sha256(regexp_replace(t, '[{sql.SPACE}]+', ' ', 'g')) as collapsed_hash, sha256({_CLEAN_SQL}) as clean_hash
from (select distinct t from (select text as t from documents where text is not null union all select * from {_values(*_ODD)} x(t)))""")
def text_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    both = table(spark, folder, "documents").select(F.col("text").alias("t")).where("t is not null").unionByName(_rows(spark, "t string", *_ODD)).distinct()
    t, digest = F.col("t"), lambda c: F.sha2(c, 256)
    return both.select(digest(t).alias("id"), text.utf16_length(t).cast("bigint").alias("units"), digest(text.strip_invisible(t)).alias("visible_hash"), digest(text.collapse_spaces(t)).alias("collapsed_hash"), digest(text.clean_text(t)).alias("clean_hash"))


_VARIABLES = (("%name% and %other% %name%%pass%", "ann and %other% annse%name%cret"), ("100%", "100%"), ("", ""))


@_query(f"select args, substituted from {_values(*_VARIABLES)} t(args, substituted)")
def substituted(spark: SparkSession, folder: str) -> DataFrame:
    known = F.create_map(F.lit("name"), F.lit("ann"), F.lit("pass"), F.lit("se%name%cret"))
    return _rows(spark, "args string", *((a,) for a, _ in _VARIABLES)).select("args", text.substitute_variables(F.col("args"), known).alias("substituted"))


_PERCENTS = (("40%", 0.4), ("250", 1.0), ("-3", 0.0), ("x", None), ("", None), (" 50 % ", 0.5), ("12.5%", 0.125))


@_query(f"select amount, clamped from {_values(*_PERCENTS)} t(amount, clamped)")
def clamped_percents(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, "amount string", *((a,) for a, _ in _PERCENTS)).select("amount", text.clamp_percent(F.col("amount")).alias("clamped"))


# ---- search

_PARSED = f"""(select response_id, provider, pos, url, {sql.strip_tags('title')} as title, {sql.strip_tags('snippet')} as snippet, engine from (
select response_id, provider, row_number() over (partition by response_id, provider order by ix) - 1 as pos, item->>'$.url' as url, coalesce(item->>'$.title', '') as title, coalesce(case when provider = 'brave' then item->>'$.description' else item->>'$.content' end, '') as snippet,
case when provider = 'brave' then 'brave' else 'searxng:' || coalesce(item->>'$.engine', 'unknown') end as engine
from (select response_id, provider, unnest(range(len(items))) as ix, unnest(items) as item from (select response_id, provider, case when json_type(l) = 'ARRAY' then cast(l as json[]) end as items from
(select response_id, provider, case when json_valid(body) then (case when provider = 'brave' then json_extract(body, '$.web.results') else json_extract(body, '$.results') end) end as l from (select distinct * from search_responses)))) where json_type(item, '$.url') = 'VARCHAR') where pos < 20)"""


def _responses(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "search_responses").distinct()


@_query(f"select * from {_PARSED}")
def parsed_results(spark: SparkSession, folder: str) -> DataFrame:
    rows = search.parse_results(_responses(spark, folder))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


_BEST = f"""(select r.*, q.query_text from {_PARSED} r join (select distinct response_id, query_text, received_at from search_responses) q on r.response_id = q.response_id
where r.response_id = (select s.response_id from (select distinct x.response_id, x.query_text, x.received_at, p.provider from {_PARSED} p join search_responses x on p.response_id = x.response_id) s where s.query_text = q.query_text order by case s.provider when 'searxng' then 1 when 'brave' then 2 else 3 end, s.received_at desc, s.response_id limit 1))"""
_TOP = f"""(select query_text, row_number() over (partition by query_text order by pos) as rank, url, title, snippet, engine from (select * from {_BEST} where pos < 10 qualify row_number() over (partition by query_text, coalesce({sql.normalised('url')}, url) order by pos) = 1) qualify rank <= 5)"""


@_query(f"select query_text, rank, url, title, engine from {_TOP}")
def top_results(spark: SparkSession, folder: str) -> DataFrame:
    top = pipelines.search(_responses(spark, folder))
    return top.select("query_text", F.col("rank").cast("bigint").alias("rank"), "url", "title", "engine")


@_query(f"""select query_text, 'search_unavailable' as error, string_agg(provider || ': пустая выдача', '; ' order by case provider when 'searxng' then 1 when 'brave' then 2 else 0 end, provider) as failures from (select distinct query_text, provider from search_responses where query_text not in (select query_text from {_BEST})) group by query_text""")
def unanswered_queries(spark: SparkSession, folder: str) -> DataFrame:
    responses = _responses(spark, folder)
    return search.unanswered(responses, search.parse_results(responses)).select("query_text", "error", "failures")


_LANDED = f"(select k, max(markdown) filter (where ok = best) as markdown, bool_or(ok) as ok from (select k, ok, markdown, max(ok) over (partition by k) as best from (select {sql.normalised('p.url')} as k, p.status is null or p.status < 400 as ok, coalesce(e.markdown, '') as markdown from pages p join extracted e on p.page_id = e.page_id)) where k is not null group by k)"


@_query(f"""select query_text, rank, url, case when rank <= 5 and ok then length({sql.truncated('s.markdown', 8000)}) end as content_length, case when rank <= 5 and ok and length(s.markdown) > 8000 then true end as truncated, case when rank <= 5 and not coalesce(ok, false) then coalesce(case when k is not null then 'upstream_error' end, 'not_found') end as error
from {_TOP} t left join {_LANDED} s on {sql.normalised('t.url')} = s.k""")
def results_with_content(spark: SparkSession, folder: str) -> DataFrame:
    top = Engine(spark, folder).search(content=True)
    return top.select("query_text", F.col("rank").cast("bigint").alias("rank"), "url", F.length("content").cast("bigint").alias("content_length"), "truncated", "error")


@_query()
def search_texts(spark: SparkSession, folder: str) -> DataFrame:
    return Engine(spark, folder).search_text()


# ---- cache

_PAYLOAD_SQL = """(json_valid(cache_value) and json_type(cache_value) = 'OBJECT' and json_type(cache_value, '$.url') = 'VARCHAR' and json_type(cache_value, '$.title') = 'VARCHAR' and json_type(cache_value, '$.markdown') = 'VARCHAR'
and (cache_value->>'$.via') in ('http', 'browser') and json_type(cache_value, '$.cached') = 'BOOLEAN' and json_type(cache_value, '$.status') in ('UBIGINT', 'BIGINT', 'DOUBLE') and coalesce(json_type(cache_value, '$.links'), 'ARRAY') = 'ARRAY')"""


@_query(f"select cache_key, created_at, coalesce(case when json_valid(cache_value) then {_PAYLOAD_SQL} end, false) as valid from (select distinct * from cache_rows)")
def cache_validity(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "cache_rows").distinct()
    return cache.with_payload(rows).select("cache_key", "created_at", F.col("payload").isNotNull().alias("valid"))


@_query(f"""select r.request_id, bool_or(c.cache_key is not null) as cached, max(c.url) as hit_url from (select distinct request_id, url, arrival from requests) r
left join (select cache_key, created_at, expires_at, cache_value->>'$.url' as url from cache_rows where json_valid(cache_value) and {_PAYLOAD_SQL}) c on sha256('scrape:' || {sql.normalised('r.url')} || ':false') = c.cache_key and c.created_at <= r.arrival and c.expires_at > r.arrival group by r.request_id""")
def cache_hits(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "requests").select("request_id", "url", "arrival").distinct()
    found = cache.lookup(asked, table(spark, folder, "cache_rows"))
    return found.groupBy("request_id").agg(F.bool_or("cached").alias("cached"), F.max("hit.url").alias("hit_url"))


_NOW = 1_750_000_000_000


@_query(f"select sum(case when expires_at <= {_NOW} then 1 else 0 end)::bigint as purged_rows, sum(case when expires_at > {_NOW} then 1 else 0 end)::bigint as kept_rows from (select distinct * from cache_rows)")
def cache_purge(spark: SparkSession, folder: str) -> DataFrame:
    return cache.purged(table(spark, folder, "cache_rows").distinct(), _NOW)


@_query("select cache_key, created_at, expires_at, sha256(cache_value) as value_hash from (select * from cache_rows union all select cache_key, 'x', created_at + 1, expires_at from cache_rows where created_at % 3 = 0) where cache_key is not null qualify row_number() over (partition by cache_key order by created_at desc, expires_at desc, cache_value desc) = 1")
def cache_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "cache_rows")
    writes = rows.where("created_at % 3 = 0").select("cache_key", F.lit("x").alias("cache_value"), (F.col("created_at") + 1).alias("created_at"), "expires_at")
    return cache.upsert(rows, writes).select("cache_key", "created_at", "expires_at", F.sha2("cache_value", 256).alias("value_hash"))


@_query(f"select cache_key, created_at from (select distinct cache_key, created_at, expires_at from cache_rows) where expires_at > {_NOW} and cache_key not in (select cache_key from cache_rows where cache_key < '4')")
def cache_delete(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "cache_rows").select("cache_key", "created_at", "expires_at").distinct()
    return cache.delete(cache.unexpired(rows, _NOW), rows.where("cache_key < '4'")).select("cache_key", "created_at")


_FOUND = f"""(select *, case when {_REFUSED('p_url')} is not null then 'invalid_url' when not {_TEXTUAL} then (case when wall is not null then 'blocked' else 'not_html' end) when wall is not null then 'blocked' when status in (403, 429, 503) then 'upstream_error'
when visible = 0 or scripts / visible > 80 or (visible < 1200 and scripts / visible > 40) then 'not_html' when status >= 400 then 'upstream_error' end as p_error from (select *, {_walls(sql.markup_only('html'))} as wall, {sql.script_length('html')} as scripts, length({sql.visible_text('html')}) as visible
from (select {sql.normalised('url')} as key, page_id, coalesce(final_url, url) as p_url, coalesce(html, '') as html, status, content_type from pages where {sql.normalised('url')} is not null qualify row_number() over (partition by {sql.normalised('url')} order by landed_at desc, page_id desc) = 1)))"""
_HITS = f"""(select sha256('scrape:' || k || ':false') as h, * from (select distinct {sql.normalised('url')} as k from requests)) a join (select cache_key, created_at, expires_at, cache_value from cache_rows where case when json_valid(cache_value) then {_PAYLOAD_SQL} else false end) c on a.h = c.cache_key"""


@_query(f"""select request_id, coalesce(case when fault is null then (case when hit is not null then hit->>'$.url' else p_url end) end, url) as url, case when fault is null then (case when hit is not null then hit->>'$.title' when p_error is null then p_title end) end as title,
case when fault is null then (case when hit is not null then hit->>'$.via' when page_id is not null then 'http' end) end as via, fault is null and hit is not null as cached, case when fault is null then (case when hit is not null then (hit->>'$.status')::double else status::double end) end as status,
case when fault is not null then fault when hit is null then (case when page_id is null then 'network' else p_error end) end as error
from (select r.request_id, r.url, {_REFUSED('r.url')} as fault, {sql.normalised('r.url')} as key, max_by(x.cache_value, x.created_at) as hit from (select distinct request_id, url, arrival from requests) r left join (select * from {_HITS}) x on {sql.normalised('r.url')} = x.k and x.created_at <= r.arrival and x.expires_at > r.arrival group by 1, 2, 3, 4) q
left join (select key, page_id, p_url, status, p_error, coalesce({_HEAD("'(?is)<title[^>]*>(.*?)</title>'")}, {_HEAD("'(?is)<h1[^>]*>(.*?)</h1>'")}, '') as p_title from {_FOUND}) f on q.key = f.key""")
def scraped_requests(spark: SparkSession, folder: str) -> DataFrame:
    return Engine(spark, folder).scrape().select("request_id", "url", "title", "via", "cached", "status", "error")


# ---- outlines

_OUTLINES = "(select doc_id, host, text, lag(text) over (partition by host order by doc_id) as before from documents where source = 'outline' and host is not null and text is not null)"
_OLD = f"list_filter(list_transform(string_split(coalesce(before, ''), chr(10)), lambda x: {sql.trim_all('x')}), lambda x: x <> '')"
_NEW = f"list_filter(string_split(text, chr(10)), lambda x: {sql.trim_all('x')} <> '' and not list_contains({_OLD}, {sql.trim_all('x')}))"


@_query(f"""select doc_id, len(n) as n_lines, sha256(coalesce(array_to_string(list_transform(n, lambda x: x[indent + 1:]), chr(10)), '')) as changed_hash from (select doc_id, n, list_min(list_transform(n, lambda x: length(regexp_extract(x, '^([{sql.SPACE}]*)', 1)))) as indent from (select doc_id, {_NEW} as n from {_OUTLINES}))""")
def outline_diffs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("source = 'outline' and host is not null and text is not null")
    changed = outline.session_diffs(rows.select(F.col("host").alias("session_id"), F.col("doc_id").alias("seq"), F.col("text").alias("outline")))
    return changed.select(F.col("seq").alias("doc_id"), F.when(F.col("changed") == "", 0).otherwise(F.size(F.split("changed", "\n", -1))).cast("bigint").alias("n_lines"), F.sha2("changed", 256).alias("changed_hash"))


_REDACTED = "array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_extract(x, '^(\\s*\\[[^\\]]*\\])', 1) || replace(replace(regexp_replace(x, '^\\s*\\[[^\\]]*\\]', ''), 'waiting room', '%place%'), 'the', '%word%')), chr(10))"


@_query(f"select doc_id, sha256({_REDACTED}) as redacted_hash from documents where source = 'outline' and text is not null")
def redacted_outlines(spark: SparkSession, folder: str) -> DataFrame:
    secrets = F.create_map(F.lit("word"), F.array(F.lit("the"), F.lit("of")), F.lit("place"), F.array(F.lit("waiting room")))
    rows = table(spark, folder, "documents").where("source = 'outline' and text is not null")
    return rows.select("doc_id", F.sha2(text.redact_outline(F.col("text"), secrets), 256).alias("redacted_hash"))


_DOM = (  # snapshot, node, parent, edge, ordinal, name, attributes, scrollable
    ("s", 1, None, "child", 0, "#document", [], False), ("s", 2, 1, "child", 0, "HTML", [], True), ("s", 3, 2, "child", 0, "BODY", [], False), ("s", 4, 3, "child", 0, "DIV", [], False),
    ("s", 5, 3, "child", 1, "DIV", [], True), ("s", 6, 5, "child", 0, "INPUT", ["id", "p", "type", "password"], False), ("s", 7, 5, "child", 1, "INPUT", ["type", "file"], False), ("s", 8, 4, "shadow", 0, "#document-fragment", [], False),
    ("s", 9, 8, "child", 0, "BUTTON", [], False), ("s", 10, 5, "child", 2, "IFRAME", [], False), ("s", 11, 10, "document", 0, "#document", [], False), ("s", 12, 11, "child", 0, "A", ["href", "/x"], False), ("s", 13, 5, "child", 3, "SELECT", [], False),
)
_DOM_SCHEMA = "snapshot_id string, node_id bigint, parent_id bigint, edge string, ordinal int, node_name string, attributes array<string>, scrollable boolean"
_AX_SCHEMA = "snapshot_id string, pos int, node_id string, parent_id string, child_ids array<string>, role string, name string, value string, properties array<struct<name string, value string>>, backend_id bigint"
_AX = (
    ("s", 0, "1", None, ["2"], "RootWebArea", "Page", None, [], 1), ("s", 1, "2", "1", ["3", "5"], "generic", "", None, [], 3), ("s", 2, "3", "2", ["4"], "button", "Send it", None, [], 9), ("s", 3, "4", "3", [], "StaticText", "Send it", None, [], None),
    ("s", 4, "5", "2", ["6", "7", "8", "9", "11"], "none", None, None, [], 5), ("s", 5, "6", "5", [], "textbox", "Password", "hunter2", [], 6), ("s", 6, "7", "5", [], "button", "File", None, [], 7), ("s", 7, "8", "5", ["10"], "generic", "", None, [], 4),
    ("s", 8, "9", "5", [], "link", "More", None, [("url", " /x ")], 12), ("s", 9, "10", "8", [], "checkbox", "Yes", None, [("checked", "true"), ("selected", "0")], 10), ("s", 10, "11", "5", ["-5"], "combobox", "Pick", "one", [], 13), ("s", 11, "-5", "11", [], "option", "ghost", None, [], None),
)
_XPATHS = (("0-1", "#document", "/"), ("0-2", "html", "/html[1]"), ("0-3", "body", "/html[1]/body[1]"), ("0-4", "div", "/html[1]/body[1]/div[1]"), ("0-5", "div", "/html[1]/body[1]/div[2]"), ("0-6", "input, password", "/html[1]/body[1]/div[2]/input[1]"), ("0-7", "input, file", "/html[1]/body[1]/div[2]/input[2]"),
           ("0-8", "#document-fragment", "/html[1]/body[1]/div[1]//"), ("0-9", "button", "/html[1]/body[1]/div[1]//button[1]"), ("0-10", "iframe", "/html[1]/body[1]/div[2]/iframe[1]"), ("0-11", "#document", "/html[1]/body[1]/div[2]/iframe[1]"), ("0-12", "a", "/html[1]/body[1]/div[2]/iframe[1]/a[1]"), ("0-13", "select", "/html[1]/body[1]/div[2]/select[1]"))
_LINES = ((1, "[0-1] RootWebArea: Page"), (2, "  [0-3] body"), (3, "    [0-9] button: Send it"), (4, "    [0-5] scrollable, div"), (5, "      [0-6] textbox: Password" + outline.PASSWORD_MASK), (6, "      [0-7] input, file: File"), (7, "      [0-10] checkbox: Yes [checked]"), (8, "      [0-12] link: More"), (9, "      [0-13] select: Pick = one"))


def _maps(spark: SparkSession) -> DataFrame:
    return outline.dom_maps(_rows(spark, _DOM_SCHEMA, *_DOM))


@_query(f"select * from {_values(*_XPATHS)} t(address, tag, xpath)")
def dom_xpaths(spark: SparkSession, folder: str) -> DataFrame:
    return _maps(spark).select("address", "tag", "xpath")


@_query(f"select * from {_values(*_LINES)} t(line_no, line)")
def ax_outline(spark: SparkSession, folder: str) -> DataFrame:
    return outline.outline_lines(outline.decorated(_rows(spark, _AX_SCHEMA, *_AX), _maps(spark))).select("line_no", "line")


@_query("select '0-12' as address, '/x' as url")
def ax_urls(spark: SparkSession, folder: str) -> DataFrame:
    return outline.decorated(_rows(spark, _AX_SCHEMA, *_AX), _maps(spark)).where("url is not null").select("address", "url")


_ACTIONS = (
    (1, "click", "0-9", None, None), (2, "dance", "0-9", None, "invalid_request"), (3, "fill", "0-6", "", None), (4, "fill", "0-6", None, "invalid_request"), (5, "press", "0-6", "", "invalid_request"),
    (6, "scrollTo", "0-5", "50%", None), (7, "scrollTo", "0-5", "far", "invalid_request"), (8, "hover", "1-5", None, "not_found"), (9, "hover", " 0-5 ", None, None), (10, "hover", "0-99", None, "not_found"),
)


@_query(f"select id, error from {_values(*_ACTIONS)} t(id, method, element_id, arg, error)")
def action_errors(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, "id int, method string, element_id string, arg string", *(a[:4] for a in _ACTIONS))
    rows = rows.select("id", "method", "element_id", F.when(F.col("arg").isNotNull(), F.array("arg")).otherwise(F.array().cast("array<string>")).alias("args"), F.lit("s").alias("snapshot_id"))
    return actions.resolved(rows, _maps(spark)).select("id", "error")


_CODES = "case error when 'invalid_url' then 400 when 'invalid_query' then 400 when 'invalid_request' then 400 when 'not_found' then 404 when 'too_large' then 413 when 'not_html' then 415 when 'blocked' then 422 when 'busy' then 429 when 'network' then 502 when 'upstream_error' then 502 when 'search_unavailable' then 503 when 'daemon_down' then 503 when 'timeout' then 504 else 500 end"
_NAMES = ("invalid_url", "invalid_query", "not_html", "blocked", "too_large", "timeout", "network", "search_unavailable", "daemon_down", "upstream_error", "invalid_request", "not_found", "busy", "internal", "unheard_of")


@_query(f"select error as code, {_CODES} as http_status from {_values(*((n,) for n in _NAMES))} t(error)")
def error_statuses(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, "code string", *((n,) for n in _NAMES)).select("code", errors.http_status(F.col("code")).alias("http_status"))


_FAULTS = (  # error, parent, place, name, code, message
    (1, None, 0, "TypeError", "", "fetch failed"), (2, 1, 0, "AggregateError", "ECONNREFUSED", ""), (3, 2, 0, "Error", "ECONNREFUSED", "connect ::1"), (4, 2, 1, "Error", "ECONNREFUSED", "connect 127.0.0.1"), (5, 2, 2, "Error", None, "c"), (6, 2, 3, "Error", None, "fourth"),
    (7, 3, 0, "E3", None, "deep"), (8, 7, 0, "E4", None, "too deep"), (9, None, 0, "Error", None, "alone"),
)


@_query(f"select * from {_values((1, 'TypeError fetch failed [AggregateError (ECONNREFUSED) [Error (ECONNREFUSED) connect ::1 [E3 deep]; Error (ECONNREFUSED) connect 127.0.0.1; Error c]]'), (9, 'Error alone'))} t(error_id, text)")
def described_errors(spark: SparkSession, folder: str) -> DataFrame:
    return errors.described(_rows(spark, "error_id int, parent_id int, place int, name string, code string, message string", *_FAULTS))


# ---- actions

_STEPS = """(select host as session_id, doc_id as seq, before, text as after, list_extract(['click', 'fill', 'dance', 'press', 'hover', 'scrollTo'], (doc_id % 6 + 1)::int) as method, case when doc_id % 5 = 0 then '1-7' else coalesce(nullif(regexp_extract(before, '\\[(0-[0-9]+)\\]', 1), ''), '0-1') end as element_id, doc_id % 7 = 0 as bare, length(host) % 3 <> 0 as known from (select host, doc_id, text, lag(text) over (partition by host order by doc_id) as before from documents where source = 'outline' and host is not null))"""
_HIDE = lambda t: f"(case when secret then array_to_string(list_transform(string_split({t}, chr(10)), lambda x: regexp_extract(x, '^(\\s*\\[[^\\]]*\\])', 1) || replace(regexp_replace(x, '^\\s*\\[[^\\]]*\\]', ''), 'the', '%word%')), chr(10)) else {t} end)"
_ACTED_OLD = f"list_transform(string_split(b, chr(10)), lambda x: {sql.trim_all('x')})"


@_query(f"""select session_id, seq, method, args, error, case when error is null then sha256(coalesce(array_to_string(list_transform(n, lambda x: x[indent + 1:]), chr(10)), '')) end as changed_hash from (
select *, list_min(list_transform(n, lambda x: length(regexp_extract(x, '^([{sql.SPACE}]*)', 1)))) as indent from (
select *, list_filter(string_split(a, chr(10)), lambda x: {sql.trim_all('x')} <> '' and not list_contains({_ACTED_OLD}, {sql.trim_all('x')})) as n from (
select session_id, seq, method, case when bare or method in ('click', 'hover', 'dance') then '' when method = 'fill' then 'the x' when method = 'press' then 'Enter' else '40%' end as args, {_HIDE("coalesce(before, '')")} as b, {_HIDE("coalesce(after, '')")} as a,
case when not known then 'not_found' when method = 'dance' or (bare and method in ('fill', 'press', 'scrollTo')) then 'invalid_request' when element_id like '1-%' then 'not_found' when not list_contains(list_transform(string_split(coalesce(before, ''), chr(10)), lambda x: regexp_extract(x, '^\\s*\\[([^\\]]*)\\]', 1)), element_id) then 'not_found' end as error
from (select *, coalesce(bool_or(method = 'fill') over (partition by session_id order by seq rows unbounded preceding), false) as secret from {_STEPS}))))""")
def acted_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Actions recorded between the outlines of each host: resolved, substituted, redacted, compared; the first error stands."""
    rows = table(spark, folder, "documents").where("source = 'outline' and host is not null")
    before = F.lag("text").over(Window.partitionBy("host").orderBy("doc_id"))
    rows = rows.select(F.col("host").alias("session_id"), F.col("doc_id").alias("seq"), before.alias("before"), F.col("text").alias("after"))
    method = F.element_at(F.array(*map(F.lit, ("click", "fill", "dance", "press", "hover", "scrollTo"))), (F.col("seq") % 6 + 1).cast("int"))
    address = F.when(F.col("seq") % 5 == 0, "1-7").otherwise(F.coalesce(F.nullif(F.regexp_extract("before", r"\[(0-[0-9]+)\]", 1), F.lit("")), F.lit("0-1")))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("method", method).withColumn("element_id", address)
    args = F.when(F.col("seq") % 7 == 0, none).when(F.col("method") == "fill", F.array(F.lit("%word% x"))).when(F.col("method") == "press", F.array(F.lit("Enter"))).when(F.col("method") == "scrollTo", F.array(F.lit("40%"))).otherwise(none)
    rows = rows.withColumn("args", args).withColumn("variables", F.when(F.col("method") == "fill", F.create_map(F.lit("word"), F.lit("the"))))
    opened = rows.select("session_id").where("length(session_id) % 3 <> 0").distinct()  # the sessions of the others were closed
    acted = Engine(spark, folder).act(rows, opened)
    return acted.select("session_id", "seq", "method", F.array_join("args", " ").alias("args"), "error", F.sha2("changed", 256).alias("changed_hash"))


_BODIES = (
    (1, "/scrape", '{"url": "x"}', None), (2, "/scrape", "{}", "invalid_url"), (3, "/scrape", '{"url": "x", "refresh": "yes"}', "invalid_request"), (4, "/search", '{"query": "q", "limit": 0}', "invalid_query"),
    (5, "/search", '{"query": "q", "limit": 3}', None), (6, "/browser/press", '{"sessionId": "s", "elementId": "0-1", "key": ""}', "invalid_request"), (7, "/browser/close", "[]", "invalid_request"), (8, "/nowhere", "{}", "not_found"),
)


@_query(f"select id, error from {_values(*_BODIES)} t(id, route, body, error)")
def request_errors(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, "id int, route string, body string", *(b[:3] for b in _BODIES))
    return rows.select("id", validation.request_error(F.col("route"), F.col("body")).alias("error"))


# ---- pacing

_ASKED = "(select distinct request_id, host, arrival from requests where host is not null and arrival is not null)"


@_query(f"select request_id, host, max(arrival - k * 500) over (partition by host order by arrival, request_id rows unbounded preceding) + k * 500 as start_at from (select *, row_number() over (partition by host order by arrival, request_id) as k from {_ASKED})")
def spaced_starts(spark: SparkSession, folder: str) -> DataFrame:
    return pacing.spaced_starts(table(spark, folder, "requests")).select("request_id", "host", "start_at")


@_query("""select session_key, session_no, min(arrival) as first_at, max(arrival) as last_at, count(*) as n_requests from (select *, sum(fresh) over (partition by session_key order by arrival, request_id rows unbounded preceding)::bigint as session_no from
(select *, case when arrival - lag(arrival) over (partition by session_key order by arrival, request_id) <= 600000 then 0 else 1 end as fresh from (select distinct request_id, session_key, arrival from requests where session_key is not null and arrival is not null))) group by 1, 2""")
def idle_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return pacing.idle_sessions(table(spark, folder, "requests"))


@_query("""with recursive r as (select *, row_number() over (partition by host order by arrival, request_id) as k from (select distinct request_id, host, arrival, greatest(coalesce(service_ms, 0), 0) as service_ms from requests where host is not null and arrival is not null)),
s as (select request_id, host, k, arrival, arrival as start_at, arrival + service_ms as end_at, -1::bigint as other from r where k = 1
union all select r.request_id, r.host, r.k, r.arrival, greatest(r.arrival, s.start_at + 500, least(s.end_at, s.other)), greatest(r.arrival, s.start_at + 500, least(s.end_at, s.other)) + r.service_ms, greatest(s.end_at, s.other) from s join r on r.host = s.host and r.k = s.k + 1)
select request_id, host, arrival, start_at, end_at from s""")
def queued_starts(spark: SparkSession, folder: str) -> DataFrame:
    return pacing.queued_starts(table(spark, folder, "requests"))


_TTL = 24 * 3_600_000


@_query(f"""with recursive r as (select *, row_number() over (partition by host order by arrival, request_id) as k from (select distinct request_id, host, arrival, via from requests where host is not null and arrival is not null)),
s as (select request_id, host, arrival, k, false as hinted, via = 'browser' as earned, case when via = 'browser' then arrival + {_TTL} else -1 end as until from r where k = 1
union all select r.request_id, r.host, r.arrival, r.k, s.until > r.arrival, s.until <= r.arrival and r.via = 'browser', case when s.until <= r.arrival and r.via = 'browser' then r.arrival + {_TTL} else s.until end from s join r on r.host = s.host and r.k = s.k + 1)
select request_id, host, case when hinted then 'browser' else 'http' end as route, earned from s""")
def hinted_routes(spark: SparkSession, folder: str) -> DataFrame:
    return pacing.hinted_routes(table(spark, folder, "requests")).select("request_id", "host", "route", "earned")


@_query(f"""with recursive r as (select *, row_number() over (partition by key order by arrival, request_id) as k from (select distinct request_id, {sql.normalised('url')} as key, arrival from requests where arrival is not null) where key is not null),
s as (select request_id, key, arrival, k, false as cached, arrival + {_TTL} as until from r where k = 1
union all select r.request_id, r.key, r.arrival, r.k, s.until > r.arrival, case when s.until > r.arrival then s.until else r.arrival + {_TTL} end from s join r on r.key = s.key and r.k = s.k + 1)
select request_id, key, arrival, cached from s""")
def cached_answers(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "requests").select("request_id", urls.normalize_url(F.col("url")).alias("key"), "arrival")
    return pacing.cached_answers(asked)


@_query()
def pooled_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return pacing.pooled_sessions(table(spark, folder, "requests"))


@_query()
def found_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of sessions: found, or not_found where the session had not been opened or was closed."""
    rows = table(spark, folder, "requests").select("request_id", "host", "session_key", "arrival", "service_ms").distinct()
    return pacing.session_lookups(rows, pacing.pooled_sessions(rows)).select("request_id", "session_key", "found", "error")


@_query(f"""select request_id, 's_' || b(arrival) || b(n) as session_id from (select *, row_number() over (order by arrival, request_id) as n from {_ASKED.replace('host is not null and ', '')})""".replace("b(arrival)", "lower(to_base(arrival, 36))").replace("b(n)", "lower(to_base(n, 36))"))
def named_sessions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "requests").select("request_id", "arrival").where("arrival is not null").distinct()
    return pacing.session_names(rows).select("request_id", "session_id")


# ---- rendered pages

_WALLED, _SHELLED = "<script>window._cf_chl_opt={}</script>", "<body><script>" + "x" * 200 + "</script></body>"
_RENDERED = f"""(select page_id, url, status, content_type, case when page_id % 4 = 0 then '{_WALLED}' when page_id % 4 = 1 then '{_SHELLED}' else html end as html, case when page_id % 8 < 6 then html end as r_html, coalesce(status, 200) as r_status from (select distinct page_id, coalesce(final_url, url) as url, coalesce(html, '') as html, status, content_type from pages))"""
_RENDER_JUDGED = f"""(select *, {_walls(sql.markup_only('html'))} as wall, {sql.script_length('html')} as scripts, length({sql.visible_text('html')}) as visible, {_walls(sql.markup_only('r_html'))} as r_wall, {sql.script_length('r_html')} as r_scripts, length({sql.visible_text('r_html')}) as r_visible from {_RENDERED})"""
_THIN = lambda p, status, typed: f"case when not {typed} then 'content_type' when {p}wall is not null then 'challenge' when {status} in (403, 429, 503) then 'status' when {p}visible = 0 then (case when {p}scripts > 0 then 'thin_spa' else 'empty_body' end) when {p}scripts / {p}visible > 80 then 'thin_spa' when {p}visible < 1200 and {p}scripts / {p}visible > 40 then 'thin_spa' end"


@_query(f"""select page_id, via, case when via = 'browser' then r_status else status end as status, case when early is not null then early when reason is not null and r_html is null then (case when wall is not null then 'blocked' when reason = 'status' then 'upstream_error' else 'not_html' end)
when reason is not null and r_wall is not null then 'blocked' when reason is not null and r_reason is not null and wall is not null then 'blocked' when reason is not null and r_reason = 'status' then 'upstream_error' when reason is not null and r_reason is not null then 'not_html'
when (case when via = 'browser' then r_status else status end) >= 400 then 'upstream_error' end as error
from (select *, case when early is null and reason is not null and r_html is not null then 'browser' else 'http' end as via from (select *, case when not {_TEXTUAL} then (case when wall is not null then 'blocked' else 'not_html' end) end as early, {_THIN('', 'status', _TEXTUAL)} as reason, {_THIN('r_', 'r_status', 'true')} as r_reason from {_RENDER_JUDGED}))""")
def rendered_fetches(spark: SparkSession, folder: str) -> DataFrame:
    """Every page behind a wall, as a shell or as it is, with what a browser made of some of them."""
    rows = table(spark, folder, "pages").select("page_id", "url", "final_url", F.coalesce("html", F.lit("")).alias("html"), "status", "content_type").distinct()
    plain = rows.withColumn("html", F.when(F.col("page_id") % 4 == 0, _WALLED).when(F.col("page_id") % 4 == 1, _SHELLED).otherwise(F.col("html")))
    rendered = rows.where("page_id % 8 < 6").select("page_id", "html", F.coalesce("status", F.lit(200)).alias("status"))
    return fetch.fetch(plain, rendered).select("page_id", "via", "status", "error")
