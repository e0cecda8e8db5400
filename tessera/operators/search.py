"""Search responses: parse, fall back, deduplicate, cut, join with page content, print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.evaluate import once
from tessera.functions.text import grouped_digits, strip_tags, truncate_markdown
from tessera.functions.urls import dedupe_key, display_host, normalize_url
from tessera.operators.bounded import settled_keys
from tessera.session import settle

#: Order in which providers are asked. Fixed values.
PROVIDERS = ("searxng", "brave")
DEFAULT_LIMIT, MOST_RESULTS, MOST_FETCHED = 5, 10, 20
CONTENT_RESULTS, CONTENT_CHARS = 5, 8_000


def _items(body: Column, path: str) -> Column:
    """The raw results of a body; null where they are no list."""
    return F.try_variant_get(F.try_parse_json(body), path, "array<variant>")


def parse_results(responses: DataFrame, limit: int = MOST_FETCHED) -> DataFrame:
    """``(response_id, provider, pos, url, title, snippet, engine)``: the results of each response, in order from 0.

    Tolerant: bodies that are no JSON, null or without a list of results give none; records whose url is no text are
    dropped, and only then the first ``limit`` are taken. Tags are stripped off titles and snippets.
    """
    body = F.col("body")
    rows = responses.select("response_id", "provider", F.when(F.col("provider") == "brave", _items(body, "$.web.results")).otherwise(_items(body, "$.results")).alias("items"))
    rows = rows.select("response_id", "provider", F.posexplode("items").alias("at", "item"))
    is_text = F.schema_of_variant(F.try_variant_get("item", "$.url", "variant")) == "STRING"
    text = lambda name: F.coalesce(F.try_variant_get("item", f"$.{name}", "string"), F.lit(""))
    rows = rows.where(is_text).withColumn("pos", F.row_number().over(Window.partitionBy("response_id", "provider").orderBy("at")) - 1).where(F.col("pos") < limit)
    engine = F.when(F.col("provider") == "brave", "brave").otherwise(F.concat(F.lit("searxng:"), F.coalesce(F.try_variant_get("item", "$.engine", "string"), F.lit("unknown"))))
    snippet = F.when(F.col("provider") == "brave", text("description")).otherwise(text("content"))
    return rows.select("response_id", "provider", "pos", F.try_variant_get("item", "$.url", "string").alias("url"), strip_tags(text("title")).alias("title"), strip_tags(snippet).alias("snippet"), engine.alias("engine"))


def first_of_each(results: DataFrame, by: list[str], url_col: str = "url", pos_col: str = "pos") -> DataFrame:
    """The first result of each page within ``by``; the order of the others is kept in ``pos_col``."""
    order = Window.partitionBy(*by, "_page").orderBy(pos_col)
    keyed = once(results, _page=dedupe_key(F.col(url_col)))
    return keyed.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "_page")


def first_provider(responses: DataFrame, results: DataFrame, by: str = "query_text") -> DataFrame:
    """For each query the results of the first provider that has any: provider order, then the latest response.

    ``responses`` has ``response_id`` and ``by``; ``results`` comes from :func:`parse_results`.
    """
    rank = F.array_position(F.array(*map(F.lit, PROVIDERS)), F.col("provider"))
    rank = F.when(rank == 0, len(PROVIDERS) + 1).otherwise(rank)
    named = results.join(responses.select("response_id", by, "received_at").distinct(), "response_id").withColumn("_rank", rank)
    best = named.groupBy(by).agg(F.min_by(F.col("response_id"), F.struct(F.col("_rank"), -F.unix_micros(F.col("received_at").cast("timestamp")), F.col("response_id"))).alias("response_id"))
    return named.join(best, [by, "response_id"]).drop("_rank", "received_at")


def unanswered(responses: DataFrame, results: DataFrame, by: str = "query_text") -> DataFrame:
    """``(query, error, failures)`` of the queries that no provider answered: what each of them said, in order."""
    answered = results.join(responses.select("response_id", by), "response_id").select(by).distinct()
    lost = responses.join(answered, by, "left_anti")
    said = F.array_sort(F.collect_set(F.struct(F.array_position(F.array(*map(F.lit, PROVIDERS)), F.col("provider")).alias("k"), F.concat(F.col("provider"), F.lit(": пустая выдача")).alias("m"))))
    return lost.groupBy(by).agg(F.array_join(F.transform(said, lambda x: x["m"]), "; ").alias("failures")).withColumn("error", F.lit("search_unavailable"))


def top_results(results: DataFrame, by: list[str], limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The first ``limit`` (at most ``MOST_RESULTS``) different results of each group, numbered from 1 in ``rank``.

    Twice as many are looked at, then duplicates go, then the cut is made: the three must stay in this order.
    """
    limit = max(1, min(limit, MOST_RESULTS))
    seen = results.where(F.col("pos") < min(2 * limit, MOST_FETCHED))
    ranked = first_of_each(seen, by).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("pos")))
    return ranked.where(F.col("rank") <= limit)


def with_content(results: DataFrame, payloads: DataFrame) -> DataFrame:
    """``results`` with ``content, truncated, remaining, error``: the first ``CONTENT_RESULTS`` ranks joined with pages.

    ``payloads`` has ``url, markdown, error``; several of one page count as the last by its text. A page that is
    missing or failed gives an error, never a lost row. Only the texts of pages among the results are shuffled.
    """
    keyed = settle(once(results, _key=F.when(F.col("rank") <= CONTENT_RESULTS, normalize_url(F.col("url")))))
    wanted = settled_keys(keyed.where("_key is not null").select(F.col("_key").alias("_page")).distinct())
    pages = once(payloads, _page=normalize_url(F.col("url"))).join(wanted, "_page", "left_semi")
    pages = pages.select("_page", F.struct(F.col("error").isNull().alias("ok"), "markdown", F.col("error").alias("e")).alias("_p"))
    pages = pages.groupBy("_page").agg(F.max("_p").alias("_p"))
    joined = keyed.join(pages, F.col("_key") == F.col("_page"), "left")
    cut = truncate_markdown(F.col("_p.markdown"), CONTENT_CHARS)
    asked, ok = F.col("rank") <= CONTENT_RESULTS, F.coalesce(F.col("_p.ok"), F.lit(False))
    out = once(joined, _cut=F.when(asked & ok, cut))
    out = out.withColumn("content", F.col("_cut.text")).withColumn("truncated", F.when(F.col("_cut.truncated"), F.lit(True)))
    out = out.withColumn("remaining", F.when(F.col("_cut.truncated"), F.col("_cut.remaining"))).withColumn("error", F.when(asked & ~ok, F.coalesce(F.col("_p.e"), F.lit("not_found"))))
    return out.drop("_key", "_page", "_p", "_cut")


def format_results(results: DataFrame, by: str) -> DataFrame:
    """``(by, text)``: the numbered blocks of each query's results (with ``rank`` and the content columns)."""
    name = F.when(F.col("title") == "", F.col("url")).otherwise(F.coalesce("title", "url"))
    lines = F.array(
        F.concat(F.col("rank").cast("string"), F.lit(". **"), name, F.lit("** — "), display_host(F.col("url"))),
        F.concat(F.lit("   "), F.col("url")),
        F.when(F.col("snippet") != "", F.concat(F.lit("   "), F.col("snippet"))),
        F.when(F.col("error").isNotNull(), F.concat(F.lit("   ⚠️ Содержимое не загружено: "), F.col("error"))),
        F.when(F.coalesce(F.col("content"), F.lit("")) != "", F.concat(F.lit("\n"), F.col("content"))),
        F.when((F.coalesce(F.col("content"), F.lit("")) != "") & F.col("truncated"), F.concat(F.lit("\n_Обрезано: осталось ещё "), grouped_digits(F.col("remaining")), F.lit(" символов._"))),
    )
    block = F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
    blocks = results.select(by, F.struct("rank", block.alias("b")).alias("x")).groupBy(by).agg(F.array_sort(F.collect_list("x")).alias("x"))
    head = F.concat(F.lit("Результаты по запросу «"), F.col(by), F.lit("» ("), F.size("x").cast("string"), F.lit("):\n"))
    return blocks.select(by, F.concat(head, F.lit("\n"), F.array_join(F.transform("x", lambda x: x["b"]), "\n")).alias("text"))


def format_page(title: Column, url: Column, via: Column, cached: Column, markdown: Column, links: Column, limit: int = 40_000) -> Column:
    """A page as text: heading, badges, body cut at ``limit``, what is left out, links."""
    from tessera.functions.text import utf16_length

    cut = truncate_markdown(F.coalesce(markdown, F.lit("")), limit)
    badges = F.concat_ws(" · ", url, F.concat(F.lit("via "), via), F.when(cached, "cached"), F.concat(grouped_digits(utf16_length(F.coalesce(markdown, F.lit("")))), F.lit(" символов")))
    heading = F.concat(F.lit("# "), F.when(F.coalesce(title, F.lit("")) == "", "Без заголовка").otherwise(title))
    notice = F.when(cut["truncated"], F.concat(F.lit("\n_Обрезано: осталось ещё "), grouped_digits(cut["remaining"]), F.lit(" символов. Увеличь maxChars, если нужен полный текст._")))
    listed = F.transform(links, lambda x: F.concat(F.lit("- ["), F.when(F.coalesce(x["text"], F.lit("")) == "", x["href"]).otherwise(x["text"]), F.lit("]("), x["href"], F.lit(")")))
    tail = F.when(F.coalesce(F.size(links), F.lit(0)) > 0, F.concat(F.lit("\n## Ссылки\n"), F.array_join(listed, "\n")))
    return F.concat_ws("\n", heading, badges, F.lit("---"), cut["text"], notice, tail)
