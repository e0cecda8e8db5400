"""Request bodies: the first field that is missing or of a wrong kind, as an error column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TEXT, _ANY_TEXT, _FLAG, _COUNT, _TEXTS = "text", "any text", "flag", "count", "texts"
_ELEMENT = (("sessionId", _TEXT, True), ("elementId", _TEXT, True))
_TYPED = (*_ELEMENT, ("text", _ANY_TEXT, True), ("variables", _TEXTS, False))
#: Fields of each route in the order they are looked at: name, kind, whether it must be there. Fixed values.
ROUTES = {
    "/scrape": (("url", _TEXT, True), ("includeLinks", _FLAG, False), ("refresh", _FLAG, False)),
    "/search": (("query", _TEXT, True), ("limit", _COUNT, False), ("fetchContent", _FLAG, False)),
    "/browser/open": (("url", _TEXT, True),),
    "/browser/snapshot": (("sessionId", _TEXT, True),),
    "/browser/click": _ELEMENT,
    "/browser/hover": _ELEMENT,
    "/browser/fill": _TYPED,
    "/browser/type": _TYPED,
    "/browser/press": (*_ELEMENT, ("key", _TEXT, True)),
    "/browser/select": (*_ELEMENT, ("value", _TEXT, True)),
    "/browser/scroll": (*_ELEMENT, ("percent", _TEXT, True)),
    "/browser/close": (("sessionId", _TEXT, True),),
}


def _good(variant: Column, name: str, kind: str, needed: bool) -> Column:
    value = F.try_variant_get(variant, f"$.{name}", "variant")
    shape = F.schema_of_variant(value)
    if kind == _TEXT:
        good = (shape == "STRING") & (F.try_variant_get(variant, f"$.{name}", "string") != "")
    elif kind == _ANY_TEXT:
        good = shape == "STRING"
    elif kind == _FLAG:
        good = shape == "BOOLEAN"
    elif kind == _COUNT:
        number = F.try_variant_get(variant, f"$.{name}", "double")
        good = shape.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL.*|DOUBLE)$") & (number > 0) & (number == F.floor(number))
    else:
        good = shape.rlike(r"^OBJECT<(\w+: STRING(, )?)*>$")
    absent = value.isNull()
    return F.when(absent, F.lit(not needed)).otherwise(F.coalesce(good, F.lit(False)))


def bad_field(route: Column, body: Column) -> Column:
    """The first field of ``body`` (JSON) that its route does not accept, ``body`` if it is no object, null if all is well."""
    variant = F.try_parse_json(body)
    is_object = F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    by_route = [F.when(route == name, F.coalesce(*(F.when(~_good(variant, n, k, needed), F.lit(n)) for n, k, needed in fields))) for name, fields in ROUTES.items()]
    return F.when(~is_object, "body").otherwise(F.coalesce(*by_route))


def request_error(route: Column, body: Column) -> Column:
    """The error code of a request: by its route and first bad field; unknown routes are not found; null if all is well."""
    field = bad_field(route, body)
    code = F.when(route == "/search", "invalid_query").when((route == "/scrape") & (field == "url"), "invalid_url").otherwise("invalid_request")
    return F.when(~route.isin(*ROUTES), "not_found").when(field.isNotNull(), code)
