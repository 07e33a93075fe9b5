"""Column functions: orders, ranks, paths, hashes, JSON, text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def by_code_point(c: Column | str) -> Column:
    """Order (a): by code point, the session's default."""
    return F.col(c) if isinstance(c, str) else c


def by_language(c: Column | str) -> Column:
    """Order (b): as a dictionary sorts."""
    return F.collate(F.col(c) if isinstance(c, str) else c, "UNICODE")


def by_location(*parts: Column) -> Column:
    """Order (d): locations as one text, so that line 10 stands before line 2."""
    return by_language(F.concat_ws(":", *[p.cast("string") for p in parts]))


def has(c: Column, query: str | Column) -> Column:
    """Case-insensitive substring."""
    return F.contains(F.lower(c), lowered(query))


def lowered(query: str | Column) -> Column:
    return F.lit(query.lower()) if isinstance(query, str) else F.lower(query)


def selector(path: Column, line: Column) -> Column:
    return F.concat(path, F.lit("@"), line.cast("string"))


def selector_path(c: Column) -> Column:
    """What stands before the last @ and digits; the whole text if there are none."""
    return F.when(c.rlike(r"^.*@\d+$"), F.regexp_extract(c, r"^(.*)@(\d+)$", 1)).otherwise(c)


def selector_line(c: Column) -> Column:
    return F.when(c.rlike(r"^.*@\d+$"), F.regexp_extract(c, r"^(.*)@(\d+)$", 2).cast("int"))


def glob_regex(glob: str) -> str:
    """``**/`` any directories, ``*`` any but a slash, ``?`` one but a slash; everything else is itself."""
    out = ""
    for m in re.finditer(r"\*\*/|\*\*|\*|\?|[^*?]+", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m[0]) or re.sub(r"([.\\+^$(){}|\[\]])", r"\\\1", m[0])
    return f"^{out}$"


def matches_glob(path: Column, glob: str) -> Column:
    """A glob with a slash is held against the whole path, one without against the last segment."""
    return (path if "/" in glob else F.element_at(F.split(path, "/"), -1)).rlike(glob_regex(glob))


def has_segments(path: Column, run: str) -> Column:
    """Whether the directories of a path hold this run of segments."""
    directories = F.concat(F.lit("/"), F.regexp_replace(path, "[^/]*$", ""))
    return F.contains(directories, F.lit(f"/{run.strip('/')}/"))


def in_project(path: Column) -> Column:
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..") & ~F.array_contains(F.split(path, "/"), "node_modules")


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def json_bytes(c: Column) -> Column:
    return F.octet_length(F.to_json(c))


def saturated(total: Column, most: int = 1_000_000) -> Column:
    return F.least(F.coalesce(total, F.lit(0)), F.lit(most)).cast("long")


def json_path(pointer: str) -> str:
    """An RFC 6901 pointer as the path that JSON functions take."""
    from .pointer import tokens

    return "$" + "".join(f"[{t}]" if t.isdigit() else f".{t}" if re.fullmatch(r"[A-Za-z_]\w*", t) else f"['{t}']" for t in tokens(pointer))


def at_pointer(json: Column, pointer: str, kind: str) -> Column:
    """The value at a pointer of JSON text; null if it is missing."""
    return F.try_variant_get(F.try_parse_json(json), json_path(pointer), kind)


def canonical_instant(c: Column) -> Column:
    """A UTC instant with milliseconds in the one accepted spelling, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")))


def strict_base64(c: Column) -> Column:
    """The bytes of base64 text in its one canonical spelling, else null."""
    raw = F.try_to_binary(c, F.lit("base64"))
    return F.when(F.regexp_replace(F.base64(raw), r"\s", "") == c, raw)


def utf8_text(c: Column) -> Column:
    """Bytes as text if they are UTF-8 from end to end, else null."""
    return F.when(F.is_valid_utf8(c), F.decode(c, "UTF-8"))


def array_items(json: Column) -> Column:
    """The number of items of a JSON array; null for anything else."""
    return F.json_array_length(json)


def identifier(c: Column) -> Column:
    return c.rlike(r"^[\p{L}_$][\p{L}\p{N}_$]*$")
