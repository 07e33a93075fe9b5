"""Diagnostics of rows: rules that each row is held against, and one record for every rule that it breaks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import member


@dataclass(frozen=True)
class Rule:
    """A row is at fault where ``broken`` holds; null is no fault."""

    code: int
    category: str
    broken: Column
    message: Column


def scan(rows: DataFrame, keep: list[str], rules: list[Rule]) -> DataFrame:
    """Rows (``keep``, code, category, message): in one pass, all rules of a row together."""
    for r in rules:
        member("category", r.category, ("Error", "Warning", "Suggestion", "Message"))
    found = [F.when(r.broken, F.struct(F.lit(r.code).alias("code"), F.lit(r.category).alias("category"), r.message.alias("message"))) for r in rules]
    return rows.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("d")).select(*keep, "d.*")
