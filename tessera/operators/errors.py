"""The error model: an error is a column, never an exception; a row with one keeps all its other columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: HTTP status of each error code. Fixed values.
STATUS = {
    "invalid_url": 400, "invalid_query": 400, "not_html": 415, "blocked": 422, "too_large": 413, "timeout": 504, "network": 502,
    "search_unavailable": 503, "daemon_down": 503, "upstream_error": 502, "invalid_request": 400, "not_found": 404, "busy": 429, "internal": 500,
}
#: What to do about an error, after its message. Fixed values.
HINTS = {
    "blocked": " Попробуй другой источник — эту страницу закрывает антибот.",
    "timeout": " Можно повторить попытку.",
    "not_found": " Открой страницу заново через browser_open или сними свежий снапшот.",
}


def http_status(code: Column) -> Column:
    """The HTTP status of an error code; unknown codes are internal, null stays null."""
    table = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(table, code), F.lit(500)))


def error(code: Column, message: Column) -> Column:
    """``struct(code, message)``, or null where there is no code."""
    return F.when(code.isNotNull(), F.struct(code.alias("code"), message.alias("message")))


def explain(code: Column, message: Column) -> Column:
    """One sentence for the reader, with a hint where there is one."""
    table = F.create_map(*[F.lit(x) for pair in HINTS.items() for x in pair])
    dotted = F.when(message.endswith("."), message).otherwise(F.concat(message, F.lit(".")))
    return F.concat(F.lit("Не удалось: "), dotted, F.coalesce(F.try_element_at(table, code), F.lit("")))


def envelope(code: Column, message: Column) -> Column:
    """The JSON body that carries an error."""
    return F.to_json(F.struct(F.struct(code.alias("code"), message.alias("message")).alias("error")))


#: Nested errors named beside their outer one, and how deep they are followed. Fixed values.
MOST_NESTED, DEEPEST = 3, 3


def describe(fault: Column) -> Column:
    """One line for an error ``struct(name, code, message)``: the code in brackets, without what is empty. Null stays null."""
    part = lambda name: F.nullif(fault[name], F.lit(""))
    head = F.concat_ws(" ", part("name"), F.concat(F.lit("("), part("code"), F.lit(")")), part("message"))
    return F.when(fault.isNotNull(), head)


def described(errors: DataFrame) -> DataFrame:
    """``(error_id, text)`` of error records ``(error_id, parent_id, place, name, code, message)``: a root with what caused it.

    A parent names its first ``MOST_NESTED`` children by ``place``, down to ``DEEPEST`` levels below the root; records
    whose parent is missing or too deep are in no text. A join per level, no recursion over data.
    """
    own = describe(F.struct("name", "code", "message"))
    rows = errors.select("error_id", "parent_id", "place", own.alias("text")).dropDuplicates(["error_id"])
    order = Window.partitionBy("parent_id").orderBy("place", "error_id")
    rows = rows.withColumn("_rn", F.when(F.col("parent_id").isNotNull(), F.row_number().over(order))).where(f"_rn is null or _rn <= {MOST_NESTED}")
    level = [rows.where("parent_id is null").select("error_id", "place", F.lit(None).cast(dict(rows.dtypes)["error_id"]).alias("parent_id"), "text")]
    for _ in range(DEEPEST):
        level.append(rows.join(level[-1].select(F.col("error_id").alias("parent_id")), "parent_id").select("error_id", "place", "parent_id", "text"))
    below = None
    for this in reversed(level):
        if below is not None:
            inner = below.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("place", "error_id", "text"))).alias("l"))
            inner = inner.select(F.col("parent_id").alias("error_id"), F.array_join(F.transform("l", lambda x: x["text"]), "; ").alias("_inner"))
            this = this.join(inner, "error_id", "left").withColumn("text", F.concat("text", F.coalesce(F.concat(F.lit(" ["), "_inner", F.lit("]")), F.lit("")))).drop("_inner")
        below = this
    return below.select("error_id", "text")
