"""The pN_ queries: each applies one operator, with production parameters, to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import p1_encoding, p2_site_lines, p3_residue, p4_near_copies, p5_language, p6_main_content, p7_encode, p8_mix, p9_split
from tessera.sources.tables import table


def p1_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return p1_encoding.garbled_fields(table(spark, folder, "pages"), table(spark, folder, "extracted"), table(spark, folder, "lang_samples"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_repaired(spark, folder).select("page_id", "field_name").distinct()


def p2_lines(spark: SparkSession, folder: str) -> DataFrame:
    return p2_site_lines.repeated_lines(table(spark, folder, "scrapes"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_lines(spark, folder).select("scrape_id", "line_no")


def p2_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    scrapes = table(spark, folder, "scrapes").select("scrape_id", "url", "markdown").distinct()
    return p2_site_lines.without_lines(scrapes, p2_lines(spark, folder)).select("scrape_id", "markdown", "removed_lines")


def p3_residue_rows(spark: SparkSession, folder: str) -> DataFrame:
    return p3_residue.find_residue(table(spark, folder, "pages"), table(spark, folder, "scrapes"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_residue_rows(spark, folder).select("record_table", "record_id")


def p3_kept_scrapes(spark: SparkSession, folder: str) -> DataFrame:
    found = p3_found(spark, folder).where("record_table = 'scrapes'").select(F.col("record_id").alias("scrape_id"))
    return table(spark, folder, "scrapes").join(found, "scrape_id", "left_anti").select("scrape_id", "url", "title", "markdown").distinct()


def p3_kept_pages(spark: SparkSession, folder: str) -> DataFrame:
    found = p3_found(spark, folder).where("record_table = 'pages'").select(F.col("record_id").alias("page_id"))
    return table(spark, folder, "pages").join(found, "page_id", "left_anti").select("page_id", "url", "html", "status").distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = p4_near_copies.near_pairs(table(spark, folder, "scrapes"), least=0.6)
    return pairs.select("scrape_a", "scrape_b")


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return p4_near_copies.near_groups(table(spark, folder, "scrapes"), least=0.6)


def p5_labels(spark: SparkSession, folder: str) -> DataFrame:
    return p5_language.wrong_labels(table(spark, folder, "extracted"), table(spark, folder, "lang_samples"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_labels(spark, folder).select("page_id", "lang_code")


def p5_segments(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "extracted").select("page_id", "markdown").distinct()
    lines = p5_language.label_lines(rows, table(spark, folder, "lang_samples"))
    return p5_language.language_segments(lines).withColumnRenamed("row_id", "page_id")


def p5_documents(spark: SparkSession, folder: str) -> DataFrame:
    return p5_language.document_labels(p5_segments(spark, folder).withColumnRenamed("page_id", "row_id")).withColumnRenamed("row_id", "page_id")


def p6_lines(spark: SparkSession, folder: str) -> DataFrame:
    return p6_main_content.label_content(table(spark, folder, "extracted"), table(spark, folder, "pages"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_lines(spark, folder).where("content < 0.5").select("page_id", "line_no")


def p6_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return p6_main_content.main_body(p6_lines(spark, folder))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return p7_encode.encode_texts(table(spark, folder, "documents"))


def p8_mix_rows(spark: SparkSession, folder: str) -> DataFrame:
    return p8_mix.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return p8_mix.shares(p8_mix_rows(spark, folder), table(spark, folder, "mix_targets"))


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return p9_split.split_oversized(table(spark, folder, "documents"), table(spark, folder, "split_limits"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_repaired": p1_repaired,
        "p2_found": p2_found,
        "p2_cleaned": p2_cleaned,
        "p3_found": p3_found,
        "p3_kept_scrapes": p3_kept_scrapes,
        "p3_kept_pages": p3_kept_pages,
        "p4_found": p4_found,
        "p4_groups": p4_groups,
        "p5_found": p5_found,
        "p5_segments": p5_segments,
        "p5_documents": p5_documents,
        "p6_found": p6_found,
        "p6_bodies": p6_bodies,
        "p7_ids": p7_ids,
        "p8_mix": p8_mix_rows,
        "p8_shares": p8_shares,
        "p9_pieces": p9_pieces,
    }


_SITE = "nullif(regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '^www\\.', ''), '')"
_PATH = "regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"

_P2 = f"""with rows as (select distinct scrape_id, {_SITE} as site, {_PATH} as path, markdown from scrapes where {_SITE} is not null),
lines as (select scrape_id, site, path, line_no, regexp_replace(lower(line), '[^\\p{{L}}]+', '', 'g') as letters from (select scrape_id, site, path, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as line from (select *, string_split(markdown, chr(10)) as l from rows where markdown is not null))),
counted as (select site, letters, count(distinct path) as pages from lines where letters <> '' group by 1, 2), sites as (select site, count(distinct path) as site_pages from rows group by 1)
select distinct l.scrape_id, l.line_no::int as line_no from lines l join counted c on l.site = c.site and l.letters = c.letters join sites s on l.site = s.site where c.pages >= 8 and c.pages * 4 >= s.site_pages"""

_P4 = """with words as (select scrape_id, regexp_extract_all(lower(markdown), '[\\p{L}\\p{N}]+') as w from (select distinct scrape_id, markdown from scrapes where markdown is not null)),
sets as (select distinct scrape_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s from words where len(w) >= 60),
sizes as (select scrape_id, count(*) as n from sets group by 1),
pairs as (select a.scrape_id as x, b.scrape_id as y, count(*) as common from sets a join sets b on a.s = b.s and a.scrape_id < b.scrape_id group by 1, 2)
select x as scrape_a, y as scrape_b from pairs join sizes p on x = p.scrape_id join sizes q on y = q.scrape_id where common >= 0.6 * (p.n + q.n - common)"""


def oracle_sql() -> dict[str, str]:
    """Two operators can be said in SQL; the others are tested against brute force, round trips or held-out rows."""
    return {"p2_found": _P2, "p4_found": _P4}
