"""Vocabularies, limits and validators shared by all operators."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence

# Vocabularies and limits that results depend on.
EDGE_KINDS = ("reference", "import", "export", "extends", "implements", "call", "contains")
PROVENANCES = ("compiler", "syntax", "heuristic")
CONFIDENCES = ("exact", "high", "medium", "low")
RESOLUTIONS = ("resolved", "unresolved", "ambiguous")
STATES = ("fresh", "pending", "stale", "rebuilding", "degraded")
CAUSES = ("source_change", "config_change", "index_failure", "watcher_failure", "compiler_rebuild")
TRUNCATIONS = ("record_limit", "byte_limit", "depth_limit", "edge_limit", "invocation_limit", "serialization_limit")
PAGE_DEFAULT, PAGE_MAX, SEARCH_DEFAULT, CANDIDATES_MAX = 100, 500, 20, 10_000
DEPTH_DEFAULT, DEPTH_MAX, NODES_DEFAULT, NODES_MAX, EDGES_DEFAULT, EDGES_MAX = 3, 32, 100, 1000, 200, 5000
WORK_DEFAULT, WORK_PROBE = 100_000, 1024
ROWS_BYTES_MAX, ROW_BYTES_MAX, SYMBOLS_MAX, FILES_MAX = 64 << 20, 4 << 20, 50_000, 10_000
CONVENTIONS_MAX, CONVENTION_CHARS, CONTEXT_CHARS = 32, 256, 500
TEST_PATTERNS, TEST_SEGMENTS = ("**/*.test.*", "**/*.spec.*"), ("test", "tests", "__tests__")
ERRORS = ("INVALID_INPUT", "PROJECT_NOT_FOUND", "PROJECT_CAPACITY_EXCEEDED", "PROJECT_QUEUE_FULL", "QUEUE_WAIT_TIMEOUT", "REQUEST_CANCELLED", "OPERATION_DEADLINE_EXCEEDED", "SERVER_SHUTTING_DOWN", "NOT_FOUND", "AMBIGUOUS_TARGET", "STALE_WORKSPACE", "INCOMPLETE_EVIDENCE", "MUTATION_BLOCKED", "CONFLICT", "INTERNAL_ERROR")


class QueryError(ValueError):
    """A refusal with a public code; a short answer is never given in its place."""

    def __init__(self, code: str, message: str, details: Sequence[str] = ()):
        super().__init__(f"{code}: {message}" + (f" [{', '.join(details)}]" if details else ""))
        self.code, self.message, self.details = code, message, list(details)


def page_bounds(offset: int, limit: int, most: int = PAGE_MAX) -> None:
    for name, value, low, high in (("offset", offset, 0, 2**53 - 1), ("limit", limit, 1, most)):
        if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
            raise QueryError("INVALID_INPUT", f"{name} must be an integer from {low} to {high}")


def member(name: str, value: str, among: Iterable[str]) -> str:
    if value not in (allowed := tuple(among)):
        raise QueryError("INVALID_INPUT", f"{name} must be one of {', '.join(allowed)}")
    return value


def relative_path(value: str) -> str:
    """A path below the root with / between segments; quotes around it are dropped."""
    path = value.strip()
    if len(path) > 1 and path[0] == path[-1] and path[0] in "'\"":
        path = path[1:-1]
    path = path.replace("\\", "/")
    if not path or path.startswith("/") or re.match(r"^[A-Za-z]:", path) or any(s in ("", ".", "..") for s in path.split("/")):
        raise QueryError("INVALID_INPUT", f"not a relative path: {value!r}")
    return path


def span(start_line: int, start_column: int | None = None, end_line: int | None = None, end_column: int | None = None) -> dict:
    """A source range; an end needs the matching start and may not lie before it."""
    parts = {"start_line": start_line, "start_column": start_column, "end_line": end_line, "end_column": end_column}
    if any(v is not None and v < 1 for v in parts.values()) or start_line is None:
        raise QueryError("INVALID_INPUT", "positions start at 1")
    if end_line is not None and end_line < start_line:
        raise QueryError("INVALID_INPUT", "the end lies before the start")
    if end_column is not None and (start_column is None or (end_line or start_line) == start_line and end_column < start_column):
        raise QueryError("INVALID_INPUT", "the end column lies before the start column")
    return parts


def conventions(values: Iterable[str]) -> list[str]:
    """Custom test conventions: trimmed, relative, each once, in the order given."""
    out: list[str] = []
    for v in values:
        v = v.strip()
        if not v or len(v) > CONVENTION_CHARS or v.startswith("/") or ".." in v.split("/"):
            raise QueryError("INVALID_INPUT", f"not a convention: {v!r}")
        if v not in out:
            out.append(v)
    if len(out) > CONVENTIONS_MAX:
        raise QueryError("INVALID_INPUT", f"more than {CONVENTIONS_MAX} conventions")
    return out


def kinds_in_order(values: Iterable[str]) -> list[str]:
    """Requested edge kinds, each once, in the order of the vocabulary."""
    wanted = {member("kind", v, EDGE_KINDS) for v in values}
    return [k for k in EDGE_KINDS if k in wanted]


def json_safe(value: object, depth: int = 64) -> object:
    """``value`` if it is JSON as it stands: texts, whole and finite numbers, truth values, null, lists and objects of these."""
    if depth == 0:
        raise QueryError("INVALID_INPUT", "the value is nested too deeply")
    if isinstance(value, dict):
        for k, v in value.items():
            if not isinstance(k, str):
                raise QueryError("INVALID_INPUT", f"not a name: {k!r}")
            json_safe(v, depth - 1)
    elif isinstance(value, list):
        for v in value:
            json_safe(v, depth - 1)
    elif isinstance(value, float):
        if not math.isfinite(value):
            raise QueryError("INVALID_INPUT", f"not a finite number: {value!r}")
    elif value is not None and not isinstance(value, (str, int, bool)):
        raise QueryError("INVALID_INPUT", f"not JSON: {type(value).__name__}")
    return value


def truncation(reasons: Iterable[str]) -> dict:
    """truncated exactly if there is a reason; the first one counts."""
    found = [member("reason", r, TRUNCATIONS) for r in reasons]
    return {"truncated": bool(found), "reason": found[0] if found else None}
