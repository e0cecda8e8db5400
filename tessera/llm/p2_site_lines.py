"""Problem 2: lines repeated across one site's documents.

Every page of a site has a dense ordinal. A line's pages are a compressed bitmap: containers of 65 536 ordinals,
each stored as a sorted array while sparse and as bits when dense. The bitmaps of spellings that differ only in
digits, marks or case are united; their exact cardinalities decide which lines are repeated. An occurrence of a line is
taken out if the bit of its page is set in the bitmap of a repeated line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dense_ordinals, if_small
from tessera.session import settle

#: A line is repeated in a site if it is on so many of its pages, and on such a part of them.
LEAST_PAGES, LEAST_SHARE = 8, 0.25
#: Ordinals of one container, and how many of them a sorted array may hold before bits are smaller.
CONTAINER_BITS, ARRAY_MOST = 16, 4_096
#: Bitmaps of at most so many bytes in all may be broadcast to the look-up.
BITMAP_BYTES = 32 << 20


def site_of(url: Column) -> Column:
    """The host in lower case without user, port and a leading ``www.``; null where there is none."""
    authority = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """The path without slashes at its end, query and fragment."""
    return F.regexp_replace(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")


def line_letters(line: Column) -> Column:
    """What makes two lines the same: their letters in lower case and in order."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def pack(ordinals: np.ndarray) -> bytes:
    """A container: sorted distinct 16-bit ordinals as an array, or as bits where that is smaller."""
    if len(ordinals) <= ARRAY_MOST:
        return b"A" + ordinals.astype("<u2").tobytes()
    bits = np.zeros(1 << CONTAINER_BITS, dtype=np.uint8)
    bits[ordinals] = 1
    return b"B" + np.packbits(bits, bitorder="little").tobytes()


def unpack(container: bytes) -> np.ndarray:
    if container[:1] == b"A":
        return np.frombuffer(container, dtype="<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, dtype=np.uint8, offset=1), bitorder="little"))


def unite(containers: list[bytes]) -> bytes:
    """The union of containers of the same range of ordinals."""
    if len(containers) == 1:
        return containers[0]
    if sum(len(c) for c in containers) <= 2 * ARRAY_MOST:
        return pack(np.unique(np.concatenate([unpack(c) for c in containers])))
    bits = np.zeros(1 << CONTAINER_BITS, dtype=bool)
    for c in containers:
        bits[unpack(c)] = True
    return pack(np.flatnonzero(bits))


def opened(container: bytes) -> tuple[list[int] | None, list[int] | None]:
    """A container as the columns that the look-up reads: its sorted ordinals, or its bits in words of 64."""
    if container[:1] == b"A":
        return unpack(container).tolist(), None
    return None, np.frombuffer(container, dtype="<i8", offset=1).tolist()


def _bitmaps(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows (site_id, line_id, chunk, variant, low) to one united container per (site_id, line_id, chunk)."""
    columns = ["site_id", "line_id", "chunk"]
    rest: pd.DataFrame | None = None

    def united(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows[[*columns, "variant"]].to_numpy()
        low = rows["low"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        ends = np.r_[starts[1:], len(keys)]
        out: dict[str, list] = {c: [] for c in (*columns, "few", "words", "pages", "variants")}
        group: list[bytes] = []
        for k, (a, b) in enumerate(zip(starts, ends)):
            group.append(pack(np.unique(low[a:b])))
            if k + 1 == len(starts) or (keys[starts[k + 1]][:3] != keys[a][:3]).any():
                whole = unite(group)
                for c, v in zip(out, (*(int(x) for x in keys[a][:3]), *opened(whole), len(unpack(whole)), len(group))):
                    out[c].append(v)
                group = []
        return pd.DataFrame(out)

    for part in parts:
        rows = part if rest is None else pd.concat([rest, part], ignore_index=True)
        if rows.empty:
            continue
        last = rows[columns].iloc[-1]
        open_ = (rows[columns] == last).all(axis=1).to_numpy()  # the last group may go on in the next batch
        cut = int(np.argmax(open_))
        rest = rows.iloc[cut:]
        if cut:
            yield united(rows.iloc[:cut])
    if rest is not None and len(rest):
        yield united(rest)


def _named(df: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """Rows with a host: (scrape_id, site, path, markdown)."""
    rows = df.select(F.col(id_col).cast("bigint").alias("scrape_id"), F.col(url_col).alias("url"), F.col(text_col).alias("markdown"))
    return rows.select("scrape_id", site_of(F.col("url")).alias("site"), path_of(F.col("url")).alias("path"), "markdown").where("site is not null")


def is_set(few: Column, words: Column, low: Column) -> Column:
    """Whether the bit of ``low`` is set in a container: among its ordinals, or in its words of 64 bits."""
    word = F.get(words, F.shiftright(low, 6))
    bit = F.call_function("shiftrightunsigned", word, low.bitwiseAND(63)).bitwiseAND(F.lit(1)) == 1
    return F.when(words.isNull(), F.array_contains(few, low)).otherwise(bit)


def _chunked(df: DataFrame) -> DataFrame:
    """``df`` with the container of each ordinal and the ordinal within it."""
    return df.withColumn("chunk", F.shiftright("ordinal", CONTAINER_BITS)).withColumn("low", F.col("ordinal").bitwiseAND((1 << CONTAINER_BITS) - 1).cast("int"))


def line_bitmaps(df: DataFrame, *, id_col: str = "scrape_id", url_col: str = "url", text_col: str = "markdown",
                 least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> tuple[DataFrame, DataFrame]:
    """Occurrences of lines that may be repeated, and the bitmaps of the lines that are.

    Occurrences: ``(scrape_id, site_id, line_no, line_id, ordinal)``, ordinal being that of the scrape's page in its
    site. Bitmaps: ``(site_id, line_id, site, pages, site_pages, chunk, few, words)``, a row for each container.
    """
    rows = _named(df, id_col, url_col, text_col)
    ordinals = dense_ordinals(rows.select("site", "path").distinct(), "site", ["path"], "ordinal")
    sites = settle(ordinals.groupBy("site").agg(F.count(F.lit(1)).alias("site_pages")).withColumn("site_id", F.xxhash64("site")))
    lines = rows.where("markdown is not null").select("scrape_id", F.xxhash64("site").alias("site_id"), F.posexplode(F.split("markdown", "\n")).alias("pos", "line"))
    letters = line_letters(F.col("line"))
    lines = lines.select("scrape_id", "site_id", (F.col("pos") + 1).alias("line_no"), letters.alias("letters"), "line").where("letters != ''")
    lines = lines.select("scrape_id", "site_id", "line_no", F.xxhash64("letters").alias("line_id"), F.xxhash64("line").alias("variant"))
    enough = F.greatest(F.lit(least_pages), F.ceil(F.col("site_pages") * least_share)).cast("bigint")
    needed = sites.select("site_id", "site", "site_pages", enough.alias("needed"))
    # occurrences are no fewer than pages: what has too few of them can't be repeated, and most lines go here
    often = lines.groupBy("site_id", "line_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    often = settle(often.join(needed, "site_id").where("n >= needed").select("site_id", "line_id"))
    kept = lines.join(if_small(often), ["site_id", "line_id"], "left_semi")
    ids = rows.select("scrape_id", "site", "path").distinct().join(ordinals, ["site", "path"]).select("scrape_id", F.xxhash64("site").alias("site_id"), "ordinal")
    kept = settle(kept.join(ids, ["scrape_id", "site_id"]).distinct())
    chunked = _chunked(kept).select("site_id", "line_id", "chunk", "variant", "low").distinct()
    chunked = chunked.repartition("site_id", "line_id", "chunk").sortWithinPartitions("site_id", "line_id", "chunk", "variant")
    bitmaps = settle(chunked.mapInPandas(_bitmaps, "site_id bigint, line_id bigint, chunk bigint, few array<int>, words array<bigint>, pages bigint, variants int"))
    found = bitmaps.groupBy("site_id", "line_id").agg(F.sum("pages").alias("pages")).join(needed, "site_id").where("pages >= needed")
    found = settle(found.select("site_id", "line_id", "site", "pages", "site_pages"))
    return kept, bitmaps.drop("pages", "variants").join(if_small(found), ["site_id", "line_id"])


def look_up(occurrences: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``(scrape_id, line_no, site, line_id, pages, site_pages)`` of the occurrences whose page's bit is set, once each."""
    bitmaps = settle(bitmaps)
    held = bitmaps.agg(F.sum(F.coalesce(F.size("few"), F.lit(0)) * 4 + F.coalesce(F.size("words"), F.lit(0)) * 8 + 100).alias("bytes")).first()["bytes"] or 0
    small = F.broadcast(bitmaps) if held <= BITMAP_BYTES else bitmaps
    met = _chunked(occurrences).join(small, ["site_id", "line_id", "chunk"]).where(is_set(F.col("few"), F.col("words"), F.col("low")))
    return met.select("scrape_id", "line_no", "site", "line_id", "pages", "site_pages").distinct()


def repeated_lines(df: DataFrame, *, id_col: str = "scrape_id", url_col: str = "url", text_col: str = "markdown",
                   least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """``(scrape_id, line_no, site, line_id, pages, site_pages)``: every occurrence of a repeated line, once.

    A line is repeated in a site if at least ``least_pages`` distinct pages and at least ``least_share`` of the
    site's distinct pages (those without text included) have it in some spelling. Rows without a host, null and
    empty texts and lines without letters give nothing; rows delivered twice count once; an empty table gives an
    empty result.
    """
    return look_up(*line_bitmaps(df, id_col=id_col, url_col=url_col, text_col=text_col, least_pages=least_pages, least_share=least_share))


def without_lines(df: DataFrame, found: DataFrame, *, id_col: str = "scrape_id", text_col: str = "markdown") -> DataFrame:
    """``df`` with the found lines taken out of each text, and ``removed_lines`` (how many); other rows stay as they are."""
    drop = found.groupBy(F.col("scrape_id").alias("__scrape_id")).agg(F.collect_set("line_no").alias("__drop"))
    kept = F.filter(F.split(text_col, "\n"), lambda line, pos: ~F.array_contains(F.col("__drop"), pos + 1))
    joined = df.join(drop, F.col(id_col).cast("bigint") == F.col("__scrape_id"), "left")
    text = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop"))
    return joined.withColumn(text_col, text).withColumn("removed_lines", removed).drop("__scrape_id", "__drop")
