"""Batch documents as one plan: each step is a join, no call is a job.

A tool is a relation between calls and rows: it gets a table of calls (pos and its typed inputs) and gives a table of rows
with the pos of the call that they answer. A document becomes one row, the context, to which every step adds one VARIANT
column: the rows of its call, or for ``foreach`` an array of the rows of each call in the order of its items. Templates
become expressions over that row. The document's limits are checks within the plan, so that a run that goes beyond one
fails, wherever it is evaluated; nothing is fetched before the plan's result is.

Defined cases: a call that no row answers gives an empty array; ``foreach`` over an empty array makes no call and gives an
empty array; a reference to what is not there fails with INVALID_REFERENCE, one to a JSON null is null; a value that does
not fit a tool's type fails with INVALID_STEP_INPUT; rows of a call come in the tool's order, ties in any.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import QueryError
from ..functions.pointer import tokens
from ..functions.scalar import json_path
from .batch import CONTEXT_BYTES, INVOCATIONS, ITEMS, STEP_BYTES, validate


@dataclass(frozen=True)
class Tool:
    """``rows`` takes calls (pos and the columns of ``takes``) and gives rows with pos, ordered within a call by ``order``."""

    takes: dict[str, str]
    rows: Callable[[DataFrame], DataFrame]
    order: tuple[str, ...] = ()


def _refuse(code: str, why: str) -> Column:
    return F.raise_error(F.lit(f"{code}: {why}"))


def _at(value: Column, path: list[str], what: str) -> Column:
    """The VARIANT at a path of a VARIANT; fails where there is none."""
    # a pointer's ~ and / stand for themselves again once it is split
    pointer = "".join("/" + t.replace("~", "~0").replace("/", "~1") for t in path)
    found = F.try_variant_get(value, json_path(pointer), "variant") if path else value
    return F.when(found.isNull(), _refuse("INVALID_REFERENCE", f"{what} points at nothing")).otherwise(found)


def _value(template: Any, item: Column | None) -> Column:
    """A template as a VARIANT over the context's columns and the item."""
    if isinstance(template, dict) and set(template) == {"$ref"}:
        step, *path = tokens(template["$ref"])
        return _at(F.col(f"`{step}`"), path, template["$ref"])
    if isinstance(template, dict) and set(template) == {"$item"}:
        return _at(item, tokens(template["$item"]), template["$item"])
    if not isinstance(template, (dict, list)) or not template:
        return F.parse_json(F.lit(json.dumps(template)))
    if isinstance(template, dict):
        return F.to_variant_object(F.struct(*[_value(v, item).alias(k) for k, v in template.items()]))
    return F.to_variant_object(F.array(*[_value(v, item) for v in template]))


def _bounded(value: Column, most: int, code: str, what: str) -> Column:
    return F.when(F.octet_length(F.to_json(value)) > most, _refuse(code, f"{what} has more than {most} bytes")).otherwise(value)


def _typed(value: Column, kind: str, name: str) -> Column:
    found = F.try_variant_get(value, "$", kind)
    return F.when(found.isNull() & ~F.is_variant_null(value), _refuse("INVALID_STEP_INPUT", f"{name} must be {kind}")).otherwise(found)


def _calls(context: DataFrame, step: dict, tool: Tool, root: str | None) -> DataFrame:
    """(pos, inputs): the calls of a step."""
    given = dict(step.get("input", {}))
    if unknown := set(given) - set(tool.takes):
        raise QueryError("INVALID_STEP_INPUT", f"{step['tool']} takes no {sorted(unknown)}")
    if root is not None and "project_root" in tool.takes and given.setdefault("project_root", root) != root:
        raise QueryError("PROJECT_ROOT_CONFLICT", "a step names another project root")
    item = None
    if "foreach" in step:
        items = F.try_variant_get(_value(step["foreach"], None), "$", "array<variant>")
        items = F.when(items.isNull(), _refuse("INVALID_FOREACH", "foreach needs an array")).when(F.size(items) > ITEMS, _refuse("FOREACH_LIMIT", f"more than {ITEMS} items")).otherwise(items)
        context, item = context.select("*", F.posexplode(items).alias("item pos", "item")).withColumnRenamed("item pos", "pos"), F.col("item")
    else:
        context = context.withColumn("pos", F.lit(0))
    inputs = [(_typed(_value(given[k], item), kind, k) if k in given else F.lit(None).cast(kind)).alias(k) for k, kind in tool.takes.items()]
    return context.select("pos", *inputs)


def compiled(spark: SparkSession, document: dict, tools: dict[str, Tool]) -> DataFrame:
    """One row: ``output``, a VARIANT, what the document emits (its last step's result by default)."""
    validate(document, tools)
    context = spark.range(1).select(F.lit(0).alias("calls made"))
    for step in document["steps"]:
        tool = tools[step["tool"]]
        calls = _calls(context, step, tool, document.get("project_root"))
        rows = tool.rows(calls)
        columns = [c for c in rows.columns if c != "pos"]
        row = F.struct(*columns)
        order = F.struct(*tool.order) if tool.order else F.lit(0)
        # a call's rows are bounded by the bytes of a step's result, calls by the items of a foreach
        answers = rows.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), row.alias("row")))).alias("rows"))
        answers = answers.select("pos", F.to_variant_object(F.transform("rows", lambda x: x["row"])).alias("answer"))
        each = calls.select("pos").join(answers, "pos", "left").select("pos", F.coalesce("answer", F.parse_json(F.lit("[]"))).alias("answer"))
        whole = each.agg(F.array_sort(F.collect_list("pos")).alias("places"), F.map_from_entries(F.collect_list(F.struct("pos", "answer"))).alias("answers"))
        ordered = F.transform("places", lambda p: F.element_at("answers", p))
        result = F.to_variant_object(ordered) if "foreach" in step else F.element_at(ordered, 1)
        one = whole.select(_bounded(result, STEP_BYTES, "RESULT_LIMIT", step["id"]).alias(step["id"]), F.size("places").alias("more calls"))
        context = context.join(F.broadcast(one))  # one row each
        made = F.col("calls made") + F.col("more calls")
        context = context.withColumn("calls made", F.when(made > INVOCATIONS, _refuse("INVOCATION_LIMIT", f"more than {INVOCATIONS} calls")).otherwise(made)).drop("more calls")
    out = _value(document["emit"], None) if "emit" in document else F.col(f"`{document['steps'][-1]['id']}`")
    kept = sum((F.octet_length(F.to_json(F.col(f"`{s['id']}`"))) for s in document["steps"]), F.lit(0))
    out = F.when(kept > CONTEXT_BYTES, _refuse("CONTEXT_LIMIT", f"results exceed {CONTEXT_BYTES} bytes")).when(F.col("calls made") < 0, None).otherwise(out)
    return context.select(_bounded(out, STEP_BYTES, "OUTPUT_LIMIT", "the output").alias("output"))


def rows_of(output: DataFrame, kind: str, nested: bool = False) -> DataFrame:
    """The rows (fields ``kind``) of an output that is an array of them, or with ``nested`` an array of such arrays."""
    array = f"array<struct<{kind}>>"
    found = F.variant_get("output", "$", f"array<{array}>" if nested else array)
    return output.select(F.explode(F.flatten(found) if nested else found).alias("x")).select("x.*")
