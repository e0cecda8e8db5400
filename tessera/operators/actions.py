"""Recorded actions on page elements: what is valid, what was meant, what may be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.evaluate import once
from tessera.functions.text import clamp_percent, redact_outline, substitute_variables
from tessera.operators.errors import explain
from tessera.operators.outline import diff_outlines, format_changed, parse_address

#: Verbs, and those among them that need an argument, or one that is not empty. Fixed values.
VERBS = ("click", "fill", "type", "press", "hover", "selectOptionFromDropdown", "scrollTo")
NEED_ARGUMENT, NEED_TEXT = ("fill", "type"), ("press", "selectOptionFromDropdown", "scrollTo")


def action_error(method: Column, element_id: Column, args: Column) -> Column:
    """``invalid_request`` or ``not_found`` for an action that can't be carried out, else null."""
    first = F.try_element_at(args, F.lit(1))
    bad = ~F.coalesce(method.isin(*VERBS), F.lit(False))
    missing = method.isin(*NEED_ARGUMENT, *NEED_TEXT) & first.isNull()
    empty = method.isin(*NEED_TEXT) & (first == "")
    percent = (method == "scrollTo") & clamp_percent(first).isNull()
    request = bad | F.coalesce(missing, F.lit(False)) | F.coalesce(empty, F.lit(False)) | F.coalesce(percent, F.lit(False))
    return F.when(request, "invalid_request").when(parse_address(element_id).isNull(), "not_found")


def resolved(actions: DataFrame, maps: DataFrame) -> DataFrame:
    """``actions`` with the ``xpath`` of their element in the snapshot they were made on, and ``error``."""
    address = F.concat(F.lit("0-"), parse_address(F.col("element_id")).cast("string"))
    joined = actions.withColumn("_address", address).join(maps.select("snapshot_id", F.col("address").alias("_address"), "xpath"), ["snapshot_id", "_address"], "left")
    fault = F.coalesce(action_error(F.col("method"), F.col("element_id"), F.col("args")), F.when(F.col("xpath").isNull(), "not_found"))
    return joined.withColumn("error", fault).drop("_address")


def performed(actions: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """``(session_id, seq, method, args, changed, error, text)`` of recorded actions: what each did to its page, with secrets out.

    ``actions`` (session_id, seq, method, element_id, args, variables, before, after) has the outlines around each
    action; ``sessions`` (session_id) those that are open, all if left out. An action fails if its session is not open
    (not_found), if it is none or lacks its argument (invalid_request), or if its element is not in the outline before
    (not_found). ``args`` have the variables' values put in. Both outlines are shown without the values of all
    variables the session has had so far, those of this action included; ``changed`` has the new lines of ``after``.
    Null outlines have no lines; null keys are no sessions; ``(session_id, seq)`` names an action, repeats count once.
    """
    rows = actions.where("session_id is not null and seq is not null").dropDuplicates(["session_id", "seq"])
    if sessions is not None:
        rows = rows.join(sessions.select("session_id", F.lit(True).alias("_open")).distinct(), "session_id", "left")
    else:
        rows = rows.withColumn("_open", F.lit(True))
    given = rows.select("session_id", "seq", F.explode("variables").alias("name", "value")).where("name is not null and value is not null")
    # a value is a secret of its session from the action on that first gave it
    since = given.groupBy("session_id", "name", "value").agg(F.min("seq").alias("_since"))
    kept = since.groupBy("session_id").agg(F.collect_list(F.struct("_since", "name", "value")).alias("_given"))
    rows = rows.join(kept, "session_id", "left")
    known = F.filter(F.coalesce("_given", F.array().cast("array<struct<_since:bigint,name:string,value:string>>")), lambda x: x["_since"] <= F.col("seq"))
    names = F.array_distinct(F.transform("_known", lambda x: x["name"]))
    values = F.map_from_arrays(names, F.transform(names, lambda n: F.array_sort(F.transform(F.filter("_known", lambda x: x["name"] == n), lambda x: x["value"]))))
    rows = once(once(rows, _known=known), _secrets=values)
    address = F.concat(F.lit("0-"), parse_address(F.col("element_id")).cast("string"))
    there = F.exists(F.split(F.coalesce("before", F.lit("")), "\n", -1), lambda line: F.regexp_extract(line, r"^\s*\[([^\]]*)\]", 1) == address)
    fault = F.when(~F.coalesce("_open", F.lit(False)), "not_found").otherwise(F.coalesce(action_error(F.col("method"), F.col("element_id"), F.col("args")), F.when(~there, "not_found")))
    rows = once(rows, error=fault, _args=F.transform("args", lambda a: substitute_variables(a, F.col("variables"))))
    clean = rows.select("session_id", "seq", *(F.when(F.col("error").isNull(), redact_outline(F.coalesce(n, F.lit("")), F.col("_secrets"))).alias(n) for n in ("before", "after")))
    changed = diff_outlines(clean, ["session_id", "seq"])
    rows = rows.select("session_id", "seq", "method", F.col("_args").alias("args"), "error").join(changed, ["session_id", "seq"])
    done = F.when(F.col("error").isNull(), F.col("changed"))
    said = F.coalesce(format_changed(done), explain(F.col("error"), F.concat_ws(" ", F.col("method"), F.col("error"))))
    return rows.select("session_id", "seq", "method", "args", done.alias("changed"), "error", said.alias("text"))


def secrets_so_far(variables: DataFrame) -> DataFrame:
    """``(session_id, seq, name, values)``: each variable's distinct values up to each step of a session."""
    order = Window.partitionBy("session_id", "name").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return variables.select("session_id", "seq", "name", F.array_sort(F.collect_set("value").over(order)).alias("values"))
