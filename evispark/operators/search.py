"""Ranked search with stable pages, over any table that has a name, a path, a line and a file.

Rows are ordered by (rank, file, position). Pages come from a global order that only ever holds the rows up to the
page's end: an ordered limit keeps the best ``offset + limit`` rows of each partition, never all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..contracts import CANDIDATES_MAX, PAGE_DEFAULT, PAGE_MAX, SEARCH_DEFAULT, QueryError, page_bounds
from ..functions.scalar import has, lowered, selector


@dataclass(frozen=True)
class Names:
    """Columns that a search looks at."""

    name: str = "name"
    path: str = "symbol_path"
    line: str = "line"
    file: str = "file_path"
    kind: str = "kind"
    position: str = "symbol_position"

    def selector(self) -> Column:
        return selector(F.col(self.path), F.col(self.line))


def matches(query: str | Column, names: Names) -> Column:
    return has(F.col(names.name), query) | has(F.col(names.path), query) | has(names.selector(), query)


def rank(query: str | Column, names: Names) -> Column:
    """0 selector, 1 path, 2 name, 3 the start of path or name, 4 anywhere; without regard to case."""
    q = lowered(query)
    name, path, sel = F.lower(F.col(names.name)), F.lower(F.col(names.path)), F.lower(names.selector())
    return F.when(sel == q, 0).when(path == q, 1).when(name == q, 2).when(path.startswith(q) | name.startswith(q), 3).otherwise(4)


def candidates(symbols: DataFrame, query: str, names: Names = Names(), kinds: list[str] | None = None, file_filter: str | None = None) -> DataFrame:
    """Matching rows with their rank."""
    if not query:
        raise QueryError("INVALID_INPUT", "the query is empty")
    out = symbols.where(matches(query, names))
    if kinds:
        out = out.where(F.col(names.kind).isin(kinds))
    if file_filter:
        out = out.where(has(F.col(names.file), file_filter))
    return out.withColumn("rank", rank(query, names))


def histogram(found: DataFrame) -> DataFrame:
    """Rows of each rank."""
    return found.groupBy("rank").agg(F.count("*").alias("n"))


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = PAGE_DEFAULT, most: int = PAGE_MAX, total: DataFrame | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in ``order``, each with total, has_more and next_offset (null at the end).

    The total is a count joined to the few rows of the page; it costs one pass of the narrowest columns.
    """
    page_bounds(offset, limit, most)
    counted = (total if total is not None else rows).agg(F.count("*").alias("total"))
    cut = rows.orderBy(*order).offset(offset).limit(limit)
    out = cut.join(F.broadcast(counted))  # one row
    end = offset + limit
    return out.withColumn("has_more", F.col("total") > end).withColumn("next_offset", F.when(F.col("total") > end, F.lit(end).cast("long")))


def ranked_page(symbols: DataFrame, query: str, names: Names = Names(), kinds: list[str] | None = None, file_filter: str | None = None, offset: int = 0, limit: int = SEARCH_DEFAULT) -> DataFrame:
    if limit > CANDIDATES_MAX:
        raise QueryError("INVALID_INPUT", f"at most {CANDIDATES_MAX} candidates")
    found = candidates(symbols, query, names, kinds, file_filter)
    order = [F.col("rank"), F.col(names.file), F.col(names.position)]
    return page(found, order, offset, limit, CANDIDATES_MAX, total=found.select("rank"))


def pages(symbols: DataFrame, calls: DataFrame, names: Names = Names(), by: str = "pos") -> DataFrame:
    """The first page of each of ``calls`` (``by``, query, limit), a small table: matching rows with rank and place.

    All calls are answered in one pass over the symbols; a task keeps no more rows of a call than its page has.
    """
    met = symbols.join(calls, matches(F.col("query"), names)).withColumn("rank", rank(F.col("query"), names))
    place = F.row_number().over(W.partitionBy(by).orderBy("rank", names.file, names.position))
    return met.withColumn("place", place).where(F.col("place") <= CANDIDATES_MAX).where(F.col("place") <= F.col("limit"))


#: Columns of each level of detail, each holding the one before.
DETAIL = {
    "selectors": ("file_path", "selector", "rank"),
    "summary": ("file_path", "selector", "rank", "symbol_path", "kind", "line"),
    "full": ("file_path", "selector", "rank", "symbol_path", "kind", "line", "name", "signature"),
}


def detail(rows: DataFrame, level: str) -> DataFrame:
    if level not in DETAIL:
        raise QueryError("INVALID_INPUT", f"detail must be one of {', '.join(DETAIL)}")
    return rows.select(*[c for c in DETAIL[level] if c in rows.columns])


def expansion(level: str, source: bool | None = None, references: bool | None = None) -> dict[str, bool]:
    """Whether source and references are attached: by level, unless asked for otherwise."""
    return {"source": level in ("context", "full") if source is None else source, "references": level == "full" if references is None else references}


def parity(base: DataFrame, index: DataFrame) -> DataFrame:
    """One row: rows of each side, rows that only one side has, and whether the index answers alike."""
    a, b = base.agg(F.count("*").alias("n_base")), index.agg(F.count("*").alias("n_index"))
    missing, extra = base.exceptAll(index).agg(F.count("*").alias("n_missing")), index.exceptAll(base).agg(F.count("*").alias("n_extra"))
    out = a.join(F.broadcast(b)).join(F.broadcast(missing)).join(F.broadcast(extra))  # one row each
    return out.withColumn("equal", (F.col("n_missing") == 0) & (F.col("n_extra") == 0))


def answer(base: DataFrame, index: DataFrame | None) -> tuple[DataFrame, bool]:
    """The base's rows on every branch, and whether the index was found corrupt: it verifies, it never answers."""
    return base, index is not None and not parity(base, index).first()["equal"]
