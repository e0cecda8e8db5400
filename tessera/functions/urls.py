"""URL functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.evaluate import let

#: Query parameters that only track: prefixes and whole names of normalisation, and the shorter list of link cleaning.
#: The two lists differ on purpose. Fixed values.
NORMALISE_PREFIXES = ("utm_", "ga_", "mc_", "_hs")
NORMALISE_NAMES = ("yclid", "gclid", "fbclid", "msclkid", "igshid", "ref_src", "si")
LINK_PREFIX = "utm_"
LINK_NAMES = ("fbclid", "gclid", "msclkid", "yclid", "mc_cid", "mc_eid", "igshid")
#: Host suffixes that never leave the own network. Fixed values.
LOCAL_SUFFIXES = (".local", ".localhost", ".internal", ".home.arpa")
DEFAULT_PORTS = {"http": "80", "https": "443"}

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_WEB = r"^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*([^/\\?#]*)"
_WEB_SCHEMES = ("http", "https")


def _trimmed(url: Column) -> Column:
    """White space at the ends and tabs and line feeds within are no part of a URL."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")


def with_parts(url: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the parts of a URL, which are read once: all, scheme, user, host, port, path (as written), query, fragment, ok.

    ``ok`` tells whether an absolute URL can be read at all: a scheme, and for web schemes a host of allowed characters
    and a port. Hosts may contain underscores; control characters, white space and ``<>^|%`` may not be in them.
    """

    def cut(u: Column, authority: Column) -> Column:
        user = F.regexp_extract(authority, r"^(.*@)", 1)
        place = F.substring(authority, F.length(user) + 1, F.length(authority))
        port = F.regexp_extract(place, r":([0-9]*)$", 1)
        return F.struct(
            u.alias("all"), F.lower(F.regexp_extract(u, _SCHEME, 1)).alias("scheme"), user.alias("user"), F.lower(F.regexp_replace(place, r":[0-9]*$", "")).alias("host"), port.alias("port"),
            F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*[^/\\?#]*([^?#]*)", 1).alias("path"), F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1).alias("query"), F.regexp_extract(u, r"(#.*)$", 1).alias("fragment"))

    def judged(p: Column) -> Column:
        host = p["host"].rlike(r"^(\[[0-9a-f:.]+\]|[^\x00-\x20<>^|%\[\]:/?#@\\]+)$")
        port = (p["port"] == "") | ((F.length(F.regexp_replace(p["port"], "^0+", "")) <= 5) & (F.coalesce(p["port"].try_cast("bigint"), F.lit(99_999)) <= 65_535))
        ok = F.coalesce(F.when(p["scheme"].isin(*_WEB_SCHEMES), host & port).otherwise(p["scheme"] != ""), F.lit(False))
        return F.struct(*(p[n].alias(n) for n in ("all", "scheme", "user", "host", "port", "path", "query", "fragment")), ok.alias("ok"))

    return let(_trimmed(url), lambda u: let(F.regexp_extract(u, _WEB, 1), lambda a: let(cut(u, a), lambda p: let(judged(p), body))))


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_trimmed(url), _SCHEME, 1))


def is_url(url: Column) -> Column:
    """Whether an absolute URL can be read at all; null is none."""
    return F.coalesce(with_parts(url, lambda p: p["ok"]), F.lit(False))


def url_host(url: Column) -> Column:
    """The host in lower case, without user and port; null where there is none."""
    return with_parts(url, lambda p: F.nullif(p["host"], F.lit("")))


def display_host(url: Column) -> Column:
    """The host, or the text itself if it is no URL."""
    return with_parts(url, lambda p: F.when(p["ok"], p["host"]).otherwise(url))


def _name(pair: Column) -> Column:
    """The decoded name of a ``name=value`` pair; as written if it can't be decoded."""
    raw = F.regexp_replace(F.split_part(pair, F.lit("="), F.lit(1)), r"\+", " ")
    return F.coalesce(F.try_url_decode(raw), raw)


def _is_normalised_away(name: Column) -> Column:
    low = F.lower(name)
    return reduce(lambda a, b: a | b, [low.startswith(p) for p in NORMALISE_PREFIXES]) | low.isin(*NORMALISE_NAMES)


def is_tracking(name: Column) -> Column:
    """Whether link cleaning drops a parameter of this decoded name."""
    low = F.lower(name)
    return low.startswith(LINK_PREFIX) | low.isin(*LINK_NAMES)


def _value(pair: Column) -> Column:
    raw = F.regexp_replace(F.regexp_extract(pair, r"(?s)=(.*)$", 1), r"\+", " ")
    return F.coalesce(F.try_url_decode(raw), raw)


def _escape_path(path: Column) -> Column:
    """Characters that a path may not hold as percent escapes; paths without any are left alone."""
    each = F.transform(F.split(path, ""), lambda c: F.when(c.rlike(r"[^\x21\x24-\x3b\x3d\x40-\x5f\x61-\x7a\x7c\x7e]"), F.regexp_replace(F.url_encode(c), r"\+", "%20")).otherwise(c))
    return F.when(path.rlike(r"[^\x21\x24-\x3b\x3d\x40-\x5f\x61-\x7a\x7c\x7e]"), F.array_join(each, "")).otherwise(path)


def _without_dots(path: Column) -> Column:
    """The path with ``.`` and ``..`` segments resolved; paths without any are left alone."""
    start = F.array().cast("array<string>")
    is_dot = lambda s: F.lower(s).isin(".", "%2e")
    is_up = lambda s: F.lower(s).isin("..", ".%2e", "%2e.", "%2e%2e")
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts), F.lit(2))), start,
        lambda out, s: F.when(is_up(s), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(is_dot(s), out).otherwise(F.array_append(out, s)))
    last = F.element_at(parts, -1)
    resolved = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when((is_dot(last) | is_up(last)) & (F.size(kept) > 0), "/").otherwise(""))
    return F.when(path.rlike(r"(?i)(^|/)(\.|%2e){1,2}(/|$)"), resolved).otherwise(path)


def _path(p: Column) -> Column:
    """The path of read parts: slashes only, escaped, dot segments resolved, never empty."""
    raw = F.regexp_replace(p["path"], r"\\", "/")
    return let(F.when(raw == "", "/").otherwise(raw), lambda x: let(_escape_path(x), _without_dots))


def _shown_port(p: Column) -> Column:
    """The port with its colon, empty for the scheme's own."""
    bare = F.regexp_replace(p["port"], "^0+(?=.)", "")
    plain = p["port"] == ""
    for name, number in DEFAULT_PORTS.items():
        plain = plain | ((p["scheme"] == name) & (bare == number))
    return F.when(plain, "").otherwise(F.concat(F.lit(":"), bare))


def _search(query: Column) -> Column:
    """The query of normalisation: what tracks is gone, names are sorted, all in form encoding."""
    raw = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda x: x != "")
    named = F.transform(raw, lambda x, i: F.struct(_name(x).alias("n"), i.alias("i"), _value(x).alias("v")))
    kept = F.array_sort(F.filter(named, lambda x: ~_is_normalised_away(x["n"])))
    joined = F.array_join(F.transform(kept, lambda x: F.concat(F.url_encode(x["n"]), F.lit("="), F.url_encode(x["v"]))), "&")
    return F.when(query.isin("", "?"), "").otherwise(let(joined, lambda j: F.when(j == "", "").otherwise(F.concat(F.lit("?"), j))))


def normalize_url(url: Column) -> Column:
    """One spelling for all that name the same page; null for what is no URL.

    No fragment, host in lower case, no default port, no tracking parameters, the others in form encoding and sorted by
    name alone (equal names keep their order), one slash at the end of the path taken away.
    """

    def body(p: Column) -> Column:
        path = let(_path(p), lambda x: F.when((F.length(x) > 1) & x.endswith("/"), F.substring(x, 1, F.length(x) - 1)).otherwise(x))
        user = F.when(p["user"].isin("@", ":@"), "").otherwise(p["user"])
        web = F.concat(p["scheme"], F.lit("://"), user, p["host"], _shown_port(p), path, _search(p["query"]))
        other = F.regexp_replace(F.concat(p["scheme"], F.regexp_extract(p["all"], r"^[A-Za-z][A-Za-z0-9+.\-]*(:.*)$", 1)), r"#.*$", "")
        return F.when(p["ok"], F.when(p["scheme"].isin(*_WEB_SCHEMES), web).otherwise(other))

    return with_parts(url, body)


def dedupe_key(url: Column) -> Column:
    """What makes two results the same: the normalised URL, or the text itself if it is no URL."""
    return F.coalesce(normalize_url(url), url)  # null only where the text is null


def scrape_key(url: Column, include_links: Column | bool = False) -> Column:
    """The key of a cached page: SHA-256 of the normalised URL and whether links come with it."""
    flag = F.lit("true" if include_links else "false") if isinstance(include_links, bool) else F.when(include_links, "true").otherwise("false")
    return F.sha2(F.concat_ws(":", F.lit("scrape"), normalize_url(url), flag), 256)


def strip_tracking(href: Column) -> Column:
    """A link without tracking parameters; whatever else it has, encoding and relative form included, stays as it is."""
    fragment = F.regexp_extract(href, r"(?s)(#.*)$", 1)
    before = F.regexp_replace(href, r"(?s)#.*$", "")
    path = F.regexp_replace(before, r"(?s)\?.*$", "")
    query = F.regexp_extract(before, r"(?s)\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    kept = F.array_join(F.filter(pairs, lambda p: ~is_tracking(_name(p))), "&")
    cleaned = F.concat(path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)), fragment)
    return F.when(F.exists(pairs, lambda p: is_tracking(_name(p))), cleaned).otherwise(href)


_NO_TAIL = r"[^\x21\x23-\x3b\x3d\x3f-\x7e]"


def _escape_tail(x: Column) -> Column:
    """A query or fragment with what it may not hold as percent escapes."""
    each = F.transform(F.split(x, ""), lambda c: F.when(c.rlike(_NO_TAIL), F.regexp_replace(F.url_encode(c), r"\+", "%20")).otherwise(c))
    return F.when(x.rlike(_NO_TAIL), F.array_join(each, "")).otherwise(x)


def _absolute(url: Column) -> Column:
    """An absolute URL as a browser writes it: scheme and host in lower case, no default port, escaped."""

    def body(p: Column) -> Column:
        web = F.concat(p["scheme"], F.lit("://"), p["user"], p["host"], _shown_port(p), _path(p), _escape_tail(p["query"]), _escape_tail(p["fragment"]))
        other = F.concat(p["scheme"], F.regexp_extract(p["all"], r"^[A-Za-z][A-Za-z0-9+.\-]*(:.*)$", 1))
        return F.when(p["ok"], F.when(p["scheme"].isin(*_WEB_SCHEMES), web).otherwise(other))

    return with_parts(url, body)


def resolve_url(href: Column, base: Column) -> Column:
    """``href`` as an absolute URL, seen from the page ``base``; null if there is none."""

    def relative(h: Column, b: Column) -> Column:
        origin = F.concat(b["scheme"], F.lit("://"), b["host"], _shown_port(b))
        target = F.regexp_replace(F.regexp_extract(h, r"^([^?#]*)", 1), r"\\", "/")
        search, fragment = F.regexp_extract(h, r"^[^?#]*(\?[^#]*)", 1), F.regexp_extract(h, r"(#.*)$", 1)
        tail = F.concat(_escape_tail(search), _escape_tail(fragment))
        settled = lambda path: let(_escape_path(path), _without_dots)
        from_root = F.concat(origin, settled(target), tail)
        from_folder = F.concat(origin, settled(F.concat(F.regexp_replace(_path(b), r"[^/]*$", ""), target)), tail)
        same = F.concat(origin, _path(b), F.when(search == "", b["query"]).otherwise(""), tail)
        network = _absolute(F.concat(b["scheme"], F.lit(":"), h))
        found = F.when(h.rlike(r"^[/\\]{2}"), network).when(h.rlike(r"^[/\\]"), from_root).when(target == "", same).otherwise(from_folder)
        return F.when(b["ok"] & b["scheme"].isin(*_WEB_SCHEMES), found)

    return let(_trimmed(href), lambda h: F.when(h.rlike(_SCHEME), _absolute(h)).otherwise(with_parts(base, lambda b: relative(h, b))))


def is_ipv4(text: Column) -> Column:
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.coalesce(text.rlike(rf"^{octet}(\.{octet}){{3}}$"), F.lit(False))


def is_private_ipv4(text: Column) -> Column:
    """Addresses of own networks, link-local, shared and reserved ones. Only for texts that are IPv4 addresses."""
    a, b = (F.split_part(text, F.lit("."), F.lit(k)).try_cast("int") for k in (1, 2))
    return (a.isin(0, 10, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | (a >= 224)


def _groups(text: Column) -> Column:
    """The eight groups of an IPv6 address in hexadecimal; null where there are not eight."""
    low = F.lower(text)
    fill = lambda s: F.filter(F.split(s, ":"), lambda x: x != "")
    head, tail = fill(F.split_part(low, F.lit("::"), F.lit(1))), fill(F.split_part(low, F.lit("::"), F.lit(2)))
    missing = 8 - F.size(head) - F.size(tail)
    short = F.when(missing >= 0, F.concat(head, F.array_repeat(F.lit("0"), missing), tail))
    whole = F.split(low, ":")
    return F.when(low.contains("::"), short).otherwise(F.when(F.size(whole) == 8, whole))


def is_ipv6(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), r":\d+\.\d+\.\d+\.\d+$", ":0:0")
    good = F.forall(F.coalesce(_groups(plain), F.array(F.lit("x"))), lambda g: g.rlike("^[0-9a-f]{1,4}$")) & (F.size(F.split(plain, "::")) <= 2)
    mapped = F.regexp_extract(text, r":(\d+\.\d+\.\d+\.\d+)$", 1)
    return F.coalesce(text.contains(":") & good & ((mapped == "") | is_ipv4(mapped)), F.lit(False))


def is_private_ipv6(text: Column) -> Column:
    low = F.lower(text)
    dotted = F.regexp_extract(low, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    groups = _groups(low)
    high, tail = (F.conv(F.try_element_at(groups, F.lit(k)), 16, 10).try_cast("int") for k in (7, 8))
    v4 = F.concat_ws(".", F.shiftright(high, 8).bitwiseAND(255), high.bitwiseAND(255), F.shiftright(tail, 8).bitwiseAND(255), tail.bitwiseAND(255))
    is_mapped = F.coalesce(F.forall(F.slice(groups, 1, 5), lambda g: g.rlike("^0+$")) & (F.try_element_at(groups, F.lit(6)) == "ffff"), F.lit(False))
    return (low.isin("::1", "::")) | low.rlike("^f[cd]") | low.rlike("^fe[89ab][0-9a-f](:|$)") | ((dotted != "") & is_private_ipv4(dotted)) | (is_mapped & F.coalesce(is_private_ipv4(v4), F.lit(False)))


def is_private_address(text: Column) -> Column:
    """Whether an address must not be fetched; what is no address counts as private."""
    return F.when(is_ipv4(text), is_private_ipv4(text)).when(is_ipv6(text), is_private_ipv6(text)).otherwise(F.lit(True))


def bare_host(host: Column) -> Column:
    """The host without brackets and without the dot at its end."""
    return F.regexp_replace(F.regexp_replace(F.lower(host), r"^\[|\]$", ""), r"\.$", "")


def url_error(url: Column) -> Column:
    """``invalid_url`` for what must not be fetched, else null.

    Allowed are web URLs whose host is neither local by name nor a private address. Null is invalid.
    """

    def body(p: Column) -> Column:
        def host_is_bad(host: Column) -> Column:
            local = (host == "localhost") | reduce(lambda a, b: a | b, [host.endswith(s) for s in LOCAL_SUFFIXES])
            address = host.rlike(r"^[0-9.]+$|:")  # only then may it be an address at all
            return local | F.when(address, (is_ipv4(host) | is_ipv6(host)) & is_private_address(host)).otherwise(False)

        return ~p["ok"] | ~p["scheme"].isin(*_WEB_SCHEMES) | let(bare_host(p["host"]), host_is_bad)

    return F.when(F.coalesce(with_parts(url, body), F.lit(True)), F.lit("invalid_url"))
