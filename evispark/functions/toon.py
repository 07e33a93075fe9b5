"""A compact tabular text for JSON values: ``key: value`` lines, and one header for a list of rows with the same keys.

``decode(encode(x)) == x`` for every JSON value; ``encode_checked`` proves it for each result it lets out.
"""

from __future__ import annotations

import json
import re
from typing import Any

from ..contracts import QueryError

MOST_BYTES = 10 << 20
_BARE = re.compile(r"[A-Za-z_][\w.-]*")


def _scalar(x: Any) -> str:
    if isinstance(x, str) and _BARE.fullmatch(x) and x not in ("null", "true", "false", "NaN", "Infinity"):
        return x
    return json.dumps(x, ensure_ascii=False)


def _key(k: str) -> str:
    return k if _BARE.fullmatch(k) else json.dumps(k, ensure_ascii=False)


def _plain(x: Any) -> bool:
    return not isinstance(x, (dict, list))


def _lines(x: Any, depth: int) -> list[str]:
    pad = "  " * depth
    if isinstance(x, dict):
        if not x:
            return [f"{pad}{{}}"]
        out = []
        for k, v in x.items():
            if _plain(v):
                out.append(f"{pad}{_key(k)}: {_scalar(v)}")
            else:
                out += [f"{pad}{_key(k)}:", *_lines(v, depth + 1)]
        return out
    if isinstance(x, list):
        if x and all(isinstance(r, dict) and r and list(r) == list(x[0]) and all(map(_plain, r.values())) for r in x):
            return [f"{pad}[{len(x)}]{{{','.join(map(_key, x[0]))}}}", *(f"{pad}  {','.join(map(_scalar, r.values()))}" for r in x)]
        out = [f"{pad}[{len(x)}]"]
        for v in x:
            out += [f"{pad}  - {_scalar(v)}"] if _plain(v) else [f"{pad}  -", *_lines(v, depth + 2)]
        return out
    return [f"{pad}{_scalar(x)}"]


def encode(x: Any) -> str:
    return "\n".join(_lines(x, 0))


class _Reader:
    token = re.compile(r'"(?:[^"\\]|\\.)*"|[^,{}\[\]:]+')

    def __init__(self, text: str):
        self.lines = [(len(s) - len(s.lstrip(" ")), s.lstrip(" ")) for s in text.split("\n")]
        self.at = 0

    @staticmethod
    def value(s: str) -> Any:
        if _BARE.fullmatch(s) and s not in ("null", "true", "false", "NaN", "Infinity"):
            return s
        return json.loads(s)

    def cells(self, s: str) -> list[Any]:
        return [self.value(m[0]) for m in self.token.finditer(s)]

    def block(self, depth: int) -> Any:
        indent, line = self.lines[self.at]
        if indent != depth:
            raise ValueError(f"line {self.at + 1}: indent {indent}, not {depth}")
        if line == "{}":
            self.at += 1
            return {}
        if m := re.fullmatch(r"\[(\d+)\](?:\{(.*)\})?", line):
            self.at += 1
            if m[2] is not None:
                keys = [json.loads(k) if k.startswith('"') else k for k in (t[0] for t in self.token.finditer(m[2]))]
                rows = []
                for _ in range(int(m[1])):
                    rows.append(dict(zip(keys, self.cells(self.lines[self.at][1]), strict=True)))
                    self.at += 1
                return rows
            out = []
            for _ in range(int(m[1])):
                item = self.lines[self.at][1]
                self.at += 1
                out.append(self.value(item[2:]) if item != "-" else self.block(depth + 4))
            return out
        key = re.match(r'("(?:[^"\\]|\\.)*"|[A-Za-z_][\w.-]*):(?: (.*))?$', line)
        if not key:
            self.at += 1
            return self.value(line)
        out = {}
        while self.at < len(self.lines) and self.lines[self.at][0] == depth:
            key = re.match(r'("(?:[^"\\]|\\.)*"|[A-Za-z_][\w.-]*):(?: (.*))?$', self.lines[self.at][1])
            name = json.loads(key[1]) if key[1].startswith('"') else key[1]
            self.at += 1
            out[name] = self.value(key[2]) if key[2] is not None else self.block(depth + 2)
        return out


def decode(text: str) -> Any:
    reader = _Reader(text)
    out = reader.block(0)
    if reader.at != len(reader.lines):
        raise ValueError("lines are left over")
    return out


def encode_checked(x: Any) -> str:
    """The text, once it is known to decode to the same value and to be small enough."""
    text = encode(x)
    if len(text.encode()) > MOST_BYTES:
        raise QueryError("INVALID_INPUT", f"the text has more than {MOST_BYTES} bytes")
    if decode(text) != x:
        raise QueryError("INTERNAL_ERROR", "the text does not decode to the same value")
    return text
