"""What a response is: real content, a shell that waits for scripts, a wall against bots, an error. Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.evaluate import once
from tessera.functions.text import SPACE, trim_all, utf16_length

#: Thresholds of the verdict. Fixed values.
THIN_TEXT, SCRIPT_RATIO, SHELL_RATIO = 1_200, 40, 80
BOT_STATUSES = (403, 429, 503)
TEXTUAL_TYPES = ("text/html", "application/xhtml", "text/plain", "+xml")
#: Technical marks of bot walls, in the order they are looked for. Fixed values.
WALLS = {
    "cloudflare": (r"window\._cf_chl_opt", r"<title[^>]*>\s*Just a moment", r"cf-browser-verification", r"/cdn-cgi/challenge-platform/[^\"'\s]*/(?:orchestrate|chl_page|invisible|managed)\b", r"challenges\.cloudflare\.com/turnstile", r"cf-turnstile"),
    "datadome": (r"js\.datadome\.co", r"datadome\s*=\s*['\"]", r"<title[^>]*>[^<]*datadome"),
    "perimeterx": (r"id=[\"']px-captcha[\"']", r"_pxAppId", r"client\.perimeterx\.net"),
    "akamai": (r"_abck=", r"akam/\d+/[0-9a-f]+"),
}
#: Marks of a wall that is up right now; an embedded widget alone is none of them. Fixed values.
LIVE_MARKS = (r"id=[\"']?challenge-(running|form|stage)[\"'\s>]", r"class=[\"']?[^\"'>]*\bcf-browser-verification\b")
LIVE_TITLE = r"just a moment|attention required|checking your browser"

_SCRIPT = r"(?is)<script.*?</script>"


def script_length(html: Column) -> Column:
    """Units in all script elements, tags included."""
    return F.aggregate(F.regexp_extract_all(html, F.lit(f"({_SCRIPT})"), F.lit(0)), F.lit(0), lambda n, s: n + utf16_length(s))


def visible_text(html: Column) -> Column:
    """The text of the body (of all, if there is none) without scripts, styles and tags, spaces collapsed."""
    body = F.when(html.rlike(r"(?is)<body[^>]*>.*</body>"), F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1)).otherwise(html)
    for pattern, by in ((_SCRIPT, " "), (r"(?is)<style.*?</style>", " "), (r"<[^>]+>", " "), (rf"[{SPACE}]+", " ")):
        body = F.regexp_replace(body, pattern, by)
    return trim_all(body)


def visible_text_length(html: Column) -> Column:
    return utf16_length(visible_text(html))


def markup_only(html: Column) -> Column:
    """Scripts, the first title and the tags outside of scripts: what a wall shows itself in, without any prose."""
    script = r"(?is)<script\b.*?</script>"
    scripts = F.regexp_extract_all(html, F.lit(f"({script})"), F.lit(0))
    title = F.filter(F.array(F.regexp_extract(html, r"(?is)(<title\b[^>]*>.*?</title>)", 1)), lambda t: t != "")
    tags = F.regexp_extract_all(F.regexp_replace(html, script, ""), F.lit(r"(<[^>]+>)"), F.lit(0))
    return F.array_join(F.concat(scripts, title, tags), "\n")


def wall_of(markup: Column) -> Column:
    """The wall whose marks ``markup`` (see :func:`markup_only`) has, or null."""
    cases = [F.when(markup.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in WALLS.items()]
    return F.coalesce(*cases)


def detect_wall(html: Column) -> Column:
    """As :func:`wall_of`, from the page itself; for many pages take :func:`measured`, which reads the markup once."""
    return wall_of(markup_only(html))


def live_wall(html: Column) -> Column:
    """Whether the page is a wall right now; pages that only embed a widget are not."""
    tags = F.array_join(F.regexp_extract_all(html, F.lit(r"(<[^>]+>)"), F.lit(0)), "\n")
    title = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    return tags.rlike("(?i)" + "|".join(LIVE_MARKS)) | title.rlike(f"(?i){LIVE_TITLE}")


def is_textual(content_type: Column) -> Column:
    """Whether a body of this type may be read as text; no type counts as text."""
    low = F.lower(content_type)
    known = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in TEXTUAL_TYPES])
    return F.when(content_type.isNull() | (content_type == ""), F.lit(True)).otherwise(known)


def measured(df: DataFrame, html_col: str = "html", prefix: str = "") -> DataFrame:
    """``df`` with ``wall``, ``scripts`` and ``visible`` of its pages, every page read once for each."""
    html = F.col(html_col)
    df = once(df, **{f"{prefix}_markup": markup_only(html)})
    out = once(df, **{f"{prefix}wall": wall_of(F.col(f"{prefix}_markup")), f"{prefix}scripts": script_length(html), f"{prefix}visible": visible_text_length(html)})
    return out.drop(f"{prefix}_markup")


def escalation_reason(status: Column, content_type: Column, wall: Column, scripts: Column, visible: Column, extracted_length: Column) -> Column:
    """Why a plain response will not do (content_type, challenge, status, thin_spa, empty_body), or null if it will."""
    present = F.greatest(F.coalesce(extracted_length, F.lit(0)), visible)
    ratio = scripts / present
    return (
        F.when(~is_textual(content_type), "content_type")
        .when(wall.isNotNull(), "challenge")
        .when(status.isin(*BOT_STATUSES), "status")
        .when(visible == 0, F.when(scripts > 0, "thin_spa").otherwise("empty_body"))
        .when(ratio > SHELL_RATIO, "thin_spa")
        .when((present < THIN_TEXT) & (ratio > SCRIPT_RATIO), "thin_spa")
    )


def render_error(status: Column, wall: Column, scripts: Column, visible: Column, earlier_wall: Column) -> Column:
    """The error of a rendered page, or null: a wall still up, a wall seen before, a bot status, nothing to read."""
    reason = escalation_reason(status, F.lit("text/html"), wall, scripts, visible, F.lit(0))
    return (
        F.when(wall.isNotNull(), "blocked")
        .when(reason.isNotNull() & earlier_wall.isNotNull(), "blocked")
        .when(reason == "status", "upstream_error")
        .when(reason.isNotNull(), "not_html")
    )


def gate_error(content_type: Column, wall: Column) -> Column:
    """The error of a body that is no text, before anything is extracted from it; null for text."""
    return F.when(~is_textual(content_type), F.when(wall.isNotNull(), "blocked").otherwise("not_html"))


def status_error(status: Column) -> Column:
    return F.when(status >= 400, "upstream_error")
