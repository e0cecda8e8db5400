"""The engine as one object over landed tables; the data side of the tools an agent calls."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import redact_outline
from tessera.functions.urls import url_error
from tessera.operators import actions as acting
from tessera.operators import outline as outlining
from tessera.operators import search as searching
from tessera.plans import pipelines
from tessera.sources.options import Options
from tessera.sources.providers import register
from tessera.sources.tables import table


@dataclass
class Engine:
    """``Engine(spark, folder)``: every method returns a DataFrame; some settle tables of keys on the way."""

    spark: SparkSession
    folder: str
    options: Options = field(default_factory=Options)

    def __post_init__(self) -> None:
        register(self.spark)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def scrape(self, requests: DataFrame | None = None) -> DataFrame:
        """Pages for ``requests`` (request_id, url, arrival), by default the landed ones."""
        requests = self.table("requests").select("request_id", "url", "arrival").distinct() if requests is None else requests
        return pipelines.scrape(requests, self.table("cache_rows"), self.table("pages"))

    def scrape_text(self, requests: DataFrame | None = None) -> DataFrame:
        """``(request_id, text)``: each page as text, or what went wrong."""
        none = F.lit(None).cast("array<struct<href string, text string>>")
        done = self.scrape(requests)
        shown = searching.format_page(F.col("title"), F.col("url"), F.col("via"), F.col("cached"), F.col("markdown"), none, self.options.page_chars)
        return done.select("request_id", F.when(F.col("error").isNull(), shown).otherwise(F.concat(F.lit("Не удалось: "), F.col("error"), F.lit("."))).alias("text"))

    def search(self, limit: int = searching.DEFAULT_LIMIT, content: bool = False) -> DataFrame:
        """Ranked results of the landed responses, on wish with the content of the landed pages."""
        payloads = self.page_payloads() if content else None
        return pipelines.search(self.table("search_responses"), payloads, limit)

    def page_payloads(self) -> DataFrame:
        """``(url, markdown, error)`` of the landed pages and what the extractor returned for them."""
        pages = self.table("pages").select("page_id", "url", "status").distinct()
        texts = self.table("extracted").select("page_id", F.coalesce("markdown", F.lit("")).alias("markdown")).distinct()
        return pages.join(texts, "page_id").select("url", "markdown", F.when(F.col("status") >= 400, "upstream_error").alias("error"))

    def search_text(self, limit: int = searching.DEFAULT_LIMIT) -> DataFrame:
        return searching.format_results(self.search(limit, content=True), "query_text")

    def snapshot(self, ax_nodes: DataFrame, dom_nodes: DataFrame) -> DataFrame:
        """``(snapshot_id, outline)``."""
        maps = outlining.dom_maps(dom_nodes)
        return outlining.outlines(outlining.outline_lines(outlining.decorated(ax_nodes, maps)))

    def diff(self, snapshots: DataFrame) -> DataFrame:
        """``(session_id, seq, changed)`` of outlines (session_id, seq, outline)."""
        return outlining.session_diffs(snapshots)

    def act(self, actions: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
        """What recorded clicks, fills, presses and so on did: arguments, changes without secrets, error, text; see ``performed``."""
        return acting.performed(actions, sessions)

    def open(self, urls: DataFrame, ax_nodes: DataFrame, dom_nodes: DataFrame, secrets: DataFrame | None = None) -> DataFrame:
        """``(snapshot_id, url, outline, error)`` of pages opened in a session (snapshot_id, url): the URL is checked, the outline shown without ``secrets`` (snapshot_id, secrets)."""
        rows = urls.join(self.snapshot(ax_nodes, dom_nodes), "snapshot_id", "left").withColumn("error", url_error(F.col("url")))
        rows = rows.join(secrets, "snapshot_id", "left") if secrets is not None else rows.withColumn("secrets", F.lit(None).cast("map<string, array<string>>"))
        shown = F.when(F.col("error").isNull(), redact_outline(F.col("outline"), F.col("secrets")))
        return rows.select("snapshot_id", "url", shown.alias("outline"), "error")

    def register_views(self) -> None:
        """The landed tables as temporary views for SQL."""
        for name in ("pages", "extracted", "scrapes", "cache_rows", "search_responses", "requests", "documents"):
            self.table(name).createOrReplaceTempView(name)
