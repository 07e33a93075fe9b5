"""Differences of bags, plan hashes, receipts, and bounded stores."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import running

#: Rows of one identity from which they are ranked in ranges instead of in one task.
HOT = 100_000


def surplus(rows: DataFrame, other: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """Rows beyond those that ``other`` has of the same identity; the later ones in ``order`` are the surplus.

    Both sides are counted before they are shuffled: an identity that holds very many rows stays one row of each. Where such
    an identity's rows must be ranked, ``order`` is to be total: they are ranked in ranges.
    """
    here = rows.groupBy(*identity).agg(F.count("*").alias("_here"))
    there = other.groupBy(*identity).agg(F.count("*").alias("_there"))
    # counts cancel first: only identities with more rows here are ranked, and those that are only here need no rank
    over = here.join(there, [here[c].eqNullSafe(there[c]) for c in identity], "left").where("_here > coalesce(_there, 0)").select(*[here[c].alias(f"_{i}") for i, c in enumerate(identity)], "_here", F.coalesce("_there", F.lit(0)).alias("_there"))
    left = rows.join(over, [rows[c].eqNullSafe(over[f"_{i}"]) for i, c in enumerate(identity)])
    alone = left.where("_there = 0").select(*[rows[c] for c in rows.columns])
    ranked = left.where("_there > 0").select(*[rows[c] for c in rows.columns], "_here", "_there")
    usual = ranked.where(F.col("_here") <= HOT).withColumn("_rn", F.row_number().over(W.partitionBy(*identity).orderBy(*order)))
    out = alone.unionByName(usual.where("_rn > _there").select(*rows.columns))
    if over.where((F.col("_here") > HOT) & (F.col("_there") > 0)).isEmpty():
        return out
    # places in identities that hold very many rows come from a running number over ranges of all of them
    placed = running(ranked.where(F.col("_here") > HOT), [F.col(c) for c in (*identity, *order)], F.lit(1), "_rn")
    first = placed.groupBy(*identity).agg(F.min("_rn").alias("_first"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in identity]
    met = placed.alias("a").join(first.alias("b"), reduce(and_, same)).where("_rn - _first + 1 > _there")
    return out.unionByName(met.select(*[f"a.{c}" for c in rows.columns]))


def delta(before: DataFrame, after: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """Added and removed rows, marked in the column change."""
    added = surplus(after, before, identity, order).withColumn("change", F.lit("added"))
    return added.unionByName(surplus(before, after, identity, order).withColumn("change", F.lit("removed")))


def added_errors(changes: DataFrame, category: str, errors: list[str]) -> DataFrame:
    """Of a delta's rows, the added ones of the given categories: what blocks a change."""
    return changes.where((F.col("change") == "added") & F.col(category).isin(errors))


def category_counts(rows: DataFrame, category: str, values: list[str]) -> DataFrame:
    return rows.agg(*[F.count_if(F.col(category) == v).alias(f"n_{v}") for v in values])


def plan_hash(changes: DataFrame, key: Column, before: Column, after: Column, by: list[str] | None = None) -> DataFrame:
    """One hash over all changes in order of key: key, hash before, hash after (empty if there is none)."""
    line = F.struct(key.cast("string").alias("k"), F.coalesce(before, F.lit("")).alias("b"), F.coalesce(after, F.lit("")).alias("a"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat(x["k"], F.lit("|"), x["b"], F.lit("|"), x["a"], F.lit("\n"))), "")
    return changes.groupBy(*(by or [])).agg(F.count("*").alias("n_changes"), F.sha2(text.cast("binary"), 256).alias("plan_hash"))


def evicted(entries: DataFrame, keep: int, access: Column, tie: Column, scope: list[str] | None = None) -> DataFrame:
    """Entries with their place by last access and whether a store of ``keep`` still holds them."""
    if scope:
        places = entries.withColumn("place", F.row_number().over(W.partitionBy(*scope).orderBy(access.desc(), tie)))
    else:
        places = running(entries, [access.desc(), tie], F.lit(1), "place").withColumn("place", F.col("place").cast("int"))
    return places.withColumn("kept", F.col("place") <= keep)


def live(entries: DataFrame, expires: Column, now: Column) -> DataFrame:
    return entries.where(expires > now)


def receipts(applied: DataFrame, operation: str, order: list[Column]) -> DataFrame:
    """The first application of each operation, and how often it was asked for again."""
    best = F.min(F.struct(*order)).alias("first")
    return applied.groupBy(operation).agg(best, (F.count("*") - 1).alias("replays"))
