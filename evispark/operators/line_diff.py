"""Differences of two versions of texts, line by line, for tables of texts.

Versions meet by their key in one join; each pair of texts is compared in Arrow batches, by anchors: lines that occur
once in both, of which the longest run in the same order on both sides stays (as patience sorting finds it). Between
anchors the same is done again; what has no anchor left is compared by its common beginning and end, and the rest is
taken out and put in as it stands. Time and memory grow with the lines of a pair, but for the logarithm of sorting.

A hunk takes ``n_old`` lines out from line ``old_at`` on (counted from 1) and puts ``lines`` in; hunks of a text are in
order and do not touch. Lines end with a newline; the last one may lack it, and is then another line than one with it.

Defined cases: a version that is null is not there: all lines of the other come or go, the ``change`` of the pair is
added or removed; both null or equal texts give no hunk; repeated keys on one side are refused by the caller's join; an
empty text has no lines.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..contracts import QueryError

#: Bytes of both versions that a task turns into lines at once, single long texts apart.
BYTES = 4 << 20
Hunk = tuple[int, int, list[str]]


def lines_of(text: str | None) -> list[str]:
    parts = (text or "").split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of lines that occur once in both, in the longest order that both share."""
    once_a, once_b = ({x for x, n in Counter(y).items() if n == 1} for y in (a, b))
    both = once_a & once_b
    at = {x: j for j, x in enumerate(b) if x in both}
    pairs = [(i, at[x]) for i, x in enumerate(a) if x in both]
    tops: list[int] = []  # the least last place of a run of each length
    last: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        tops[k : k + 1], last[k : k + 1] = [j], [n]
        back.append(last[k - 1] if k else -1)
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def hunks(old: list[str], new: list[str]) -> list[Hunk]:
    """(place, lines taken out, lines put in) that make ``new`` of ``old``."""
    out: list[Hunk] = []
    waiting = [(0, len(old), 0, len(new))]
    while waiting:
        a, b, c, d = waiting.pop()
        while a < b and c < d and old[a] == new[c]:
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
        if a == b and c == d:
            continue
        if a == b or c == d or not (found := _anchors(old[a:b], new[c:d])):
            out.append((a, b - a, new[c:d]))
            continue
        edges = [(a - 1, c - 1), *((a + i, c + j) for i, j in found), (b, d)]
        waiting += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def patched(old: list[str], changes: list[Hunk]) -> list[str]:
    """``old`` with hunks in order applied."""
    out, at = [], 0
    for place, n, lines in changes:
        out += [*old[at:place], *lines]
        at = place + n
    return out + old[at:]


SCHEMA = "change string, hunk int, old_at int, n_old int, lines array<string>"


def line_diff(before: DataFrame, after: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, change, hunk, old_at, n_old, lines): the hunks of every text that differs; ``key`` is unique on both sides."""
    if key in ("old", "new", "change", "hunk", "old_at", "n_old", "lines"):
        raise QueryError("INVALID_INPUT", f"the key may not be named {key}")
    pairs = before.select(key, F.col(text).alias("old")).join(after.select(key, F.col(text).alias("new")), key, "full")
    pairs = pairs.where(~F.col("old").eqNullSafe(F.col("new")))
    kind = pairs.schema[key].dataType.simpleString()

    fields = to_arrow_schema(StructType.fromDDL(f"`{key}` {kind}, {SCHEMA}"))

    def compared(batches):
        for batch in batches:
            size = 0
            keys, olds, news = (batch.column(c) for c in (key, "old", "new"))
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                old, new = olds[i].as_py(), news[i].as_py()
                change = "added" if old is None else "removed" if new is None else "changed"
                found = hunks(lines_of(old), lines_of(new)) or [(0, 0, [])]
                rows += [(keys[i].as_py(), change, h, place + 1, n, lines) for h, (place, n, lines) in enumerate(found)]
                size += len(old or "") + len(new or "")
                if size > BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], fields)
                    rows, size = [], 0

    return pairs.mapInArrow(compared, f"`{key}` {kind}, {SCHEMA}")


def applied(before: DataFrame, difference: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text) after the hunks of ``difference``: texts without any stay, removed ones go."""
    each = difference.groupBy(key).agg(F.max("change").alias("change"), F.array_sort(F.collect_list(F.struct("hunk", "old_at", "n_old", "lines"))).alias("hunks"))  # a text's own lines
    met = before.select(key, F.col(text).alias("old")).join(each, key, "full").where("change is null or change <> 'removed'")
    kind = met.schema[key].dataType.simpleString()

    def put(batches):
        for batch in batches:
            texts = []
            for old, some in zip(batch.column("old"), batch.column("hunks"), strict=True):
                changes = [(h["old_at"] - 1, h["n_old"], h["lines"]) for h in some.as_py() or []]
                texts.append("".join(patched(lines_of(old.as_py()), changes)) if changes else old.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], names=[key, text])

    return met.select(key, "old", "hunks").mapInArrow(put, f"`{key}` {kind}, `{text}` string")
