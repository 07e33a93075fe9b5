"""JSON pointers (RFC 6901) into plain values."""

from __future__ import annotations

from typing import Any

from ..contracts import QueryError

FORBIDDEN = ("__proto__", "prototype", "constructor")


def tokens(pointer: str) -> list[str]:
    text = pointer[1:] if pointer.startswith("#") else pointer
    if text and not text.startswith("/"):
        raise QueryError("INVALID_REFERENCE", f"a pointer starts with /: {pointer!r}")
    out = [t.replace("~1", "/").replace("~0", "~") for t in text.split("/")[1:]]
    if bad := [t for t in out if t in FORBIDDEN]:
        raise QueryError("INVALID_REFERENCE", f"forbidden segment {bad[0]!r}")
    return out


def resolve(value: Any, pointer: str) -> Any:
    for t in tokens(pointer):
        if isinstance(value, dict) and t in value:
            value = value[t]
        elif isinstance(value, list) and t.isdigit() and (t == "0" or t[0] != "0") and int(t) < len(value):
            value = value[int(t)]
        else:
            raise QueryError("MISSING_REFERENCE", f"nothing at {pointer!r}")
    return value
