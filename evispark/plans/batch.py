"""Batch documents: named steps with back references and bounded fan-out, checked before anything runs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import QueryError, json_safe
from ..functions.pointer import resolve, tokens

# Limits of a document and its run.
STEPS, ITEMS, INVOCATIONS, CONCURRENCY, CONCURRENCY_MAX = 50, 200, 500, 4, 16
DOCUMENT_BYTES, STEP_BYTES, CONTEXT_BYTES = 1 << 20, 10 << 20, 50 << 20
READS = ("list_files", "explore", "get_outline", "get_symbol_source", "search_symbols", "find_references", "find_test_candidates", "get_diagnostics")
PREPARES = ("rename_symbol", "replace_symbol_body", "scaffold_class")


def _references(template: Any, name: str) -> list[str]:
    if isinstance(template, dict):
        if name in template and len(template) == 1:
            return [template[name]]
        return [r for v in template.values() for r in _references(v, name)]
    return [r for v in template for r in _references(v, name)] if isinstance(template, list) else []


def load(text: str) -> dict:
    """A document from text, validated."""
    if len(text.encode()) > DOCUMENT_BYTES:
        raise QueryError("INVALID_INPUT", "the document is too large")
    try:
        return validate(json.loads(text))
    except json.JSONDecodeError as e:
        raise QueryError("INVALID_INPUT", f"not JSON: {e}") from e


def validate(document: dict, tools: dict | None = None) -> dict:
    def refuse(why: str) -> None:
        raise QueryError("INVALID_INPUT", why)

    if not isinstance(document, dict) or document.get("version") != 1:
        refuse("version must be 1")
    json_safe(document)
    if extra := set(document) - {"version", "project_root", "limits", "steps", "emit"}:
        refuse(f"unknown keys {sorted(extra)}")
    steps = document.get("steps")
    if not isinstance(steps, list) or not 1 <= len(steps) <= STEPS:
        refuse(f"1 to {STEPS} steps are needed")
    if not 1 <= document.get("limits", {}).get("concurrency", CONCURRENCY) <= CONCURRENCY_MAX:
        refuse(f"concurrency must lie from 1 to {CONCURRENCY_MAX}")
    seen: list[str] = []
    for at, step in enumerate(steps):
        if not isinstance(step, dict) or set(step) - {"id", "tool", "input", "foreach"} or not re.fullmatch(r"[A-Za-z_][\w-]*", str(step.get("id", ""))):
            refuse(f"step {at} is malformed")
        if step["id"] in seen:
            refuse(f"step id {step['id']} repeats")
        tool = step.get("tool")
        if tools is not None and tool not in tools:
            refuse(f"unknown tool {tool!r}")
        if tools is None and tool not in READS + PREPARES:
            refuse(f"tool {tool!r} cannot run in a batch")
        if tool in PREPARES and (at != len(steps) - 1 or "foreach" in step):
            raise QueryError("FORBIDDEN_FOREACH_TOOL" if "foreach" in step else "INVALID_INPUT", "only the last step may prepare, and once")
        for ref in _references([step.get("input"), step.get("foreach")], "$ref"):
            if not (path := tokens(ref)) or path[0] not in seen:
                raise QueryError("INVALID_REFERENCE", f"{ref!r} names no earlier step")
        if "foreach" not in step and _references(step.get("input"), "$item"):
            raise QueryError("INVALID_ITEM_REFERENCE", "$item stands outside of foreach")
        seen.append(step["id"])
    for ref in _references(document.get("emit"), "$ref"):
        if not (path := tokens(ref)) or path[0] not in seen:
            raise QueryError("INVALID_REFERENCE", f"{ref!r} names no step")
    return document


def fill(template: Any, context: dict, item: Any = None) -> Any:
    """A template with every $ref and $item replaced by what it points at."""
    if isinstance(template, dict):
        if set(template) == {"$ref"}:
            return resolve(context, template["$ref"])
        if set(template) == {"$item"}:
            return resolve(item, template["$item"])
        return {k: fill(v, context, item) for k, v in template.items()}
    return [fill(v, context, item) for v in template] if isinstance(template, list) else template


def _bytes(x: Any) -> int:
    return len(json.dumps(x, ensure_ascii=False, default=str).encode())


class Runner:
    """Runs documents over tools that return tables or plain values; a table's rows become plain values, within limits."""

    def __init__(self, tools: dict[str, Callable[..., Any]]):
        self.tools = tools

    def _call(self, tool: str, values: dict) -> Any:
        if not isinstance(values, dict):
            raise QueryError("INVALID_STEP_INPUT", "a step's input must be an object")
        try:
            out = self.tools[tool](**values)
        except QueryError:
            raise
        except Exception as e:
            raise QueryError("TOOL_ERROR", f"{tool}: {e}") from e
        if isinstance(out, DataFrame):
            # a step's result is bounded by its bytes; no more rows than could fit are fetched
            out = [r.asDict(recursive=True) for r in out.limit(STEP_BYTES // 2).toLocalIterator()]
        if _bytes(out) > STEP_BYTES:
            raise QueryError("RESULT_LIMIT", f"{tool} gives more than {STEP_BYTES} bytes")
        return out

    def run(self, document: dict) -> Any:
        validate(document, self.tools)
        context: dict[str, Any] = {}
        calls, kept = 0, 0
        root = document.get("project_root")
        for step in document["steps"]:
            if "foreach" in step:
                items = fill(step["foreach"], context)
                if not isinstance(items, list):
                    raise QueryError("INVALID_FOREACH", "foreach needs an array")
                if len(items) > ITEMS:
                    raise QueryError("FOREACH_LIMIT", f"more than {ITEMS} items")
                inputs = [fill(step.get("input", {}), context, i) for i in items]  # all of them before any call
            else:
                inputs = [fill(step.get("input", {}), context)]
            for values in inputs:
                if root is not None and values.setdefault("project_root", root) != root:
                    raise QueryError("PROJECT_ROOT_CONFLICT", "a step names another project root")
            calls += len(inputs)
            if calls > INVOCATIONS:
                raise QueryError("INVOCATION_LIMIT", f"more than {INVOCATIONS} calls")
            with ThreadPoolExecutor(document.get("limits", {}).get("concurrency", CONCURRENCY)) as pool:
                results = list(pool.map(lambda v, t=step["tool"]: self._call(t, v), inputs))
            context[step["id"]] = results if "foreach" in step else results[0]
            kept += _bytes(context[step["id"]])
            if kept > CONTEXT_BYTES:
                raise QueryError("CONTEXT_LIMIT", f"results exceed {CONTEXT_BYTES} bytes")
        out = fill(document["emit"], context) if "emit" in document else context[document["steps"][-1]["id"]]
        if _bytes(out) > STEP_BYTES:
            raise QueryError("OUTPUT_LIMIT", f"the output exceeds {STEP_BYTES} bytes")
        return out


def foreach(rows: DataFrame, items: str, most: int | None = ITEMS) -> DataFrame:
    """One row for each item of an array column, with its place; an array beyond ``most`` is refused, not cut."""
    if most is not None:
        rows = rows.withColumn(items, F.when(F.size(items) > most, F.raise_error(F.lit(f"FOREACH_LIMIT: more than {most} items"))).otherwise(F.col(items)))
    others = [c for c in rows.columns if c != items]
    return rows.select(*others, F.posexplode(items).alias("pos", "item"))
