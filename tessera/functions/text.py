"""Text functions as Column expressions; lengths count UTF-16 units unless they say otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that nobody sees, the private-use glyphs of icon fonts among them; joiners stay. Fixed values.
INVISIBLE = r"[\x{ad}\x{200b}\x{2060}\x{feff}\x{e000}-\x{f8ff}]"
#: White space of the reference semantics, as the body of a character class. Fixed values.
SPACE = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: Spaces that look like one but are not found by a search for it. Fixed values.
HARD_SPACES = r"[\x{a0}\x{202f}\x{2007}\x{feff}]"
#: Inline elements that search engines leave in titles and snippets. Fixed values.
INLINE_TAGS = ("span", "strong", "b", "em", "i", "mark", "u", "small", "code", "a", "p", "div", "br", "wbr", "sup", "sub", "del", "ins", "font")
SHORTEST_SECRET = 3


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters outside the basic plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def trim_all(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{SPACE}]+\z", "")


def collapse_spaces(text: Column) -> Column:
    """Each run of white space as one blank; the ends are not trimmed."""
    return F.regexp_replace(text, rf"[{SPACE}]+", " ")


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def clean_text(text: Column) -> Column:
    """A node's name for printing: no icon glyphs, runs of hard spaces as one blank (none after a blank), trimmed."""
    plain = F.regexp_replace(text, r"[\x{e000}-\x{f8ff}]", "")
    return trim_all(F.regexp_replace(F.regexp_replace(plain, f"(?<= ){HARD_SPACES}+", ""), f"{HARD_SPACES}+", " "))


def strip_tags(text: Column) -> Column:
    """Without known inline tags, and without one that was cut off at the end; other angle brackets stay."""
    name = "(?:" + "|".join(INLINE_TAGS) + ")(?![a-zA-Z0-9])"
    prefixes = sorted({t[: k + 1] for t in INLINE_TAGS for k in range(len(t))}, key=lambda t: (-len(t), t))
    whole = rf"""(?i)</?{name}(?:[^>"']|"[^"]*"|'[^']*')*>"""
    cut = rf"(?i)</?(?:{'|'.join(prefixes)})[^>]*\z"
    return trim_all(F.regexp_replace(F.regexp_replace(text, whole, ""), cut, ""))


def truncate_markdown(text: Column, limit: Column | int) -> Column:
    """``struct(text, truncated, remaining)``: at most ``limit`` units, cut at the last blank line if it lies in the
    second half, trimmed at its end, never in the middle of a character. Null stays null; limits below 0 count as 0.
    """
    cap = F.greatest(F.lit(0), F.lit(limit) if isinstance(limit, int) else limit)
    total = utf16_length(text)
    units = F.encode(text, "UTF-16BE")
    # a pair of surrogates that the cut would tear apart stays out as a whole
    half = (cap > 0) & F.hex(F.substring(units, F.greatest(cap * 2 - 1, F.lit(1)).cast("int"), F.lit(2))).rlike("^D[89AB]")
    window = F.decode(F.substring(units, F.lit(1), (cap * 2 - F.when(half, 2).otherwise(0)).cast("int")), "UTF-16BE")
    head = F.regexp_extract(window, r"(?s)^(.*)\n\n", 1)
    found = window.rlike(r"\n\n")
    at = F.when(found, utf16_length(head)).otherwise(F.lit(-1))
    cut = F.when(at > cap * 0.5, trim_end(head)).otherwise(trim_end(window))
    short = total <= cap
    return F.when(text.isNotNull(), F.struct(
        F.when(short, text).otherwise(cut).alias("text"), (~short).alias("truncated"),
        F.when(short, F.lit(0)).otherwise(total - utf16_length(cut)).alias("remaining")))


def plain_text(markdown: Column) -> Column:
    """What one reads of a Markdown text: no tags, fences, images, link targets, escapes and marks; spaces collapsed."""
    steps = [
        (r"<[^>]+>", ""), (r"```[^\n]*\n?", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\\([\\`*_{}\[\]()#+\-.!|>~])", "$1"), (r"[#>*_`|]", ""), (rf"(?m)^[ \t]*[-+][{SPACE}]+", ""), (rf"[{SPACE}]+", " "),
    ]
    return trim_all(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, markdown))


def plain_text_length(markdown: Column) -> Column:
    return utf16_length(plain_text(markdown))


def cleanup_markdown(markdown: Column) -> Column:
    """At most one blank line in a row, no blanks at the ends of lines, trimmed."""
    return trim_all(F.regexp_replace(F.regexp_replace(markdown, r"\n{3,}", "\n\n"), r"(?m)[ \t]+$", ""))


def grouped_digits(number: Column) -> Column:
    """A number with a hard space between groups of three digits."""
    return F.replace(F.format_number(number, 0), F.lit(","), F.lit(chr(0xA0)))


def substitute_variables(text: Column, variables: Column) -> Column:
    """``%name%`` replaced by the variable's value, in one pass; unknown names stay."""
    # one pass: the text is cut at its placeholders, each is looked up, and all is joined again
    marked = F.regexp_replace(text, r"%([A-Za-z0-9_]+)%", "\u0001%$1%\u0001")
    look = lambda p: F.coalesce(F.when(p.rlike(r"^%[A-Za-z0-9_]+%\z"), F.try_element_at(variables, F.regexp_replace(p, "%", ""))), p)
    return F.when(variables.isNull(), text).otherwise(F.array_join(F.transform(F.split(marked, "\u0001", -1), look), ""))


def secret_entries(secrets: Column) -> Column:
    """The values of a map of lists as (name, value), longest value first; values under three units are no secrets."""
    flat = F.flatten(F.transform(F.map_entries(secrets), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("name"), v.alias("value")))))
    kept = F.filter(flat, lambda x: utf16_length(x["value"]) >= SHORTEST_SECRET)
    order = F.transform(kept, lambda x, i: F.struct((-utf16_length(x["value"])).alias("k"), i.alias("i"), x["name"].alias("name"), x["value"].alias("value")))
    return F.array_sort(order)


def redact(text: Column, secrets: Column) -> Column:
    """Every value of ``secrets`` in ``text`` as ``%name%``, longer values first."""
    out = F.aggregate(secret_entries(secrets), text, lambda t, e: F.replace(t, e["value"], F.concat(F.lit("%"), e["name"], F.lit("%"))))
    return F.when(secrets.isNull() | (F.size(secrets) == 0), text).otherwise(out)


def redact_outline(outline: Column, secrets: Column) -> Column:
    """As :func:`redact`, but the address at the start of each line is never touched."""
    prefix = rf"^([{SPACE}]*\[[^\]]*\])"
    one = lambda line: F.concat(F.regexp_extract(line, prefix, 1), redact(F.regexp_replace(line, prefix, ""), secrets))
    return F.array_join(F.transform(F.split(outline, "\n", -1), one), "\n")


def xml_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def clamp_percent(text: Column) -> Column:
    """``"40%"`` or ``"40"`` as 0.4, kept between 0 and 1; null if it is no number."""
    number = F.replace(trim_all(text), F.lit("%"), F.lit("")).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), F.least(F.greatest(number, F.lit(0.0)), F.lit(100.0)) / 100)
