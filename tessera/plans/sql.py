"""Fragments of the SQL that the queries are checked against; DuckDB's dialect, RE2 patterns."""

from __future__ import annotations

SPACE = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
NOT_PAGE = r"[A-Za-z][A-Za-z0-9+.-]*"


def trim_all(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def trim_end(x: str) -> str:
    return f"regexp_replace({x}, '[{SPACE}]+$', '')"


def units(x: str) -> str:
    r"""Length in UTF-16 units."""
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def authority(u: str) -> str:
    return f"regexp_extract(trim({u}), '^{NOT_PAGE}:/*([^/?#]*)', 1)"


def scheme(u: str) -> str:
    return f"lower(regexp_extract(trim({u}), '^({NOT_PAGE}):', 1))"


def host(u: str) -> str:
    return f"nullif(lower(regexp_replace(regexp_replace({authority(u)}, '^.*@', ''), ':[0-9]*$', '')), '')"


def normalised(u: str) -> str:
    """Web URLs whose paths and parameters need no escapes; null for others."""
    tracked = "regexp_matches(lower(split_part(p, '=', 1)), '^(utm_|ga_|mc_|_hs|(yclid|gclid|fbclid|msclkid|igshid|ref_src|si)$)')"
    pairs = f"list_filter(string_split(regexp_extract(trim({u}), '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' and not {tracked})"
    named = f"list_sort(list_transform({pairs}, lambda p, i: {{'n': split_part(p, '=', 1), 'i': i, 'v': regexp_extract(p, '=(.*)$', 1)}}))"
    query = f"array_to_string(list_transform({named}, lambda x: x.n || '=' || x.v), '&')"
    path = f"coalesce(nullif(regexp_extract(trim({u}), '^{NOT_PAGE}:/*[^/?#]*([^?#]*)', 1), ''), '/')"
    path = f"(case when length({path}) > 1 and {path} like '%/' then {path}[:-2] else {path} end)"
    port = f"regexp_extract({authority(u)}, ':([0-9]+)$', 1)"
    shown = f"(case when {port} = '' or ({scheme(u)} = 'http' and {port} = '80') or ({scheme(u)} = 'https' and {port} = '443') then '' else ':' || {port} end)"
    return f"(case when {scheme(u)} in ('http', 'https') and {host(u)} is not null then {scheme(u)} || '://' || {host(u)} || {shown} || {path} || (case when {query} = '' then '' else '?' || {query} end) end)"


def origin(u: str) -> str:
    """Scheme, host and port of a web URL."""
    port = f"regexp_extract({authority(u)}, ':([0-9]+)$', 1)"
    shown = f"(case when {port} = '' or ({scheme(u)} = 'http' and {port} = '80') or ({scheme(u)} = 'https' and {port} = '443') then '' else ':' || {port} end)"
    return f"({scheme(u)} || '://' || {host(u)} || {shown})"


def visible(x: str) -> str:
    return f"regexp_replace({x}, '[\\x{{ad}}\\x{{200b}}\\x{{2060}}\\x{{feff}}\\x{{e000}}-\\x{{f8ff}}]', '', 'g')"


def unescaped(x: str) -> str:
    """Numeric character references and those of the five marks as the characters they stand for."""
    point = "try_cast(case when lower(r) like '&#x%' then '0x' || r[4:-2] else r[3:-2] end as int)"
    found = f"list_distinct(regexp_extract_all({x}, '&#(?:[0-9]+|[xX][0-9a-fA-F]+);'))"
    # as browsers read them, the numbers of control characters mean those of a Windows code page
    numbers = f"list_reduce(list_prepend({x}, {found}), lambda t, r: replace(t, r, case when {point} between 128 and 159 then coalesce(map {{{', '.join(f'{k}: {chr(39)}{v}{chr(39)}' for k, v in _WINDOWS.items())}}}[{point}], chr({point})) else chr({point}) end))"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("amp", "&")):
        numbers = f"replace({numbers}, '&{name};', '{char}')"
    return numbers


#: The characters of bytes 128 to 159 in that code page.
_WINDOWS = {k: bytes([k]).decode("cp1252") for k in range(128, 160) if bytes([k]).decode("cp1252", "ignore")}


def strip_tags(x: str) -> str:
    tags = "span|strong|b|em|i|mark|u|small|code|a|p|div|br|wbr|sup|sub|del|ins|font"
    names = sorted({t[: k + 1] for t in tags.split("|") for k in range(len(t))}, key=lambda t: (-len(t), t))
    whole = rf"""(?i)</?(?:{tags})(?:[^a-zA-Z0-9>"''](?:[^>"'']|"[^"]*"|''[^'']*'')*|"[^"]*"(?:[^>"'']|"[^"]*"|''[^'']*'')*)?>"""
    cut = rf"(?i)</?(?:{'|'.join(names)})[^>]*$"
    return trim_all(f"regexp_replace(regexp_replace({x}, '{whole}', '', 'g'), '{cut}', '')")


def truncated(x: str, cap: int) -> str:
    """The cut text; for texts without characters outside the basic plane."""
    head = f"{x}[:{cap}]"
    at = f"(length({head}) - strpos(reverse({head}), chr(10) || chr(10)) - 1)"
    found = f"(strpos(reverse({head}), chr(10) || chr(10)) > 0)"
    return f"(case when length({x}) <= {cap} then {x} when {found} and {at} > {cap} * 0.5 then {trim_end(f'{head}[:{at}]')} else {trim_end(head)} end)"


def visible_text(h: str) -> str:
    body = f"(case when regexp_matches({h}, '(?is)<body[^>]*>.*</body>') then regexp_extract({h}, '(?is)<body[^>]*>(.*)</body>', 1) else {h} end)"
    for pattern in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "<[^>]+>", f"[{SPACE}]+"):
        body = f"regexp_replace({body}, '{pattern}', ' ', 'g')"
    return trim_all(body)


def script_length(h: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all({h}, '(?is)<script.*?</script>'), lambda s: length(s))), 0)"


def markup_only(h: str) -> str:
    tags = f"regexp_extract_all(regexp_replace({h}, '(?is)<script\\b.*?</script>', '', 'g'), '<[^>]+>')"
    scripts = f"regexp_extract_all({h}, '(?is)<script\\b.*?</script>')"
    title = f"list_filter([regexp_extract({h}, '(?is)(<title\\b[^>]*>.*?</title>)', 1)], lambda t: t <> '')"
    return f"array_to_string(list_concat(list_concat({scripts}, {title}), {tags}), chr(10))"


def plain_text(x: str) -> str:
    steps = [
        ("<[^>]+>", ""), ("```[^\\n]*\\n?", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"),
        (r"\\([\\`*_{}\[\]()#+\-.!|>~])", r"\1"), ("[#>*_`|]", ""), (f"(?m)^[ \\t]*[-+][{SPACE}]+", ""), (f"[{SPACE}]+", " "),
    ]
    for pattern, by in steps:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return trim_all(x)
