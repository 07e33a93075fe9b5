"""Passages that stand word for word in other texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole words, or characters, in a row by which a passage and a text meet before the passage is searched for.
RUN = 3
#: Words of 64 bits of the filter of wanted runs that every task holds.
FILTER = 1 << 16


def _runs(parts: str, k: int) -> Column:
    """A hash for each run of ``k`` of a column of words or characters."""
    n = F.greatest(F.size(parts) - k + 1, F.lit(0))
    return F.transform(F.slice(parts, F.lit(1), n), lambda _, i: F.xxhash64(F.lit(k), *[F.get(parts, i + j) for j in range(k)]))


def _words(text: str) -> Column:
    return F.split(F.trim(F.col(text)), r"\s+")


def _keyed(passages: DataFrame, text: str) -> DataFrame:
    """Adds kind, k and run: by which words or characters a passage meets texts.

    The words of a passage but the first and last one are whole words of every text that contains it, and so are up to RUN
    of them; a passage of two words and less has none, and goes by its first characters.
    """
    inner = F.size("_w") - 2
    k = F.when(inner > 0, F.least(inner, F.lit(RUN))).otherwise(F.least(F.length(text), F.lit(RUN)))
    out = passages.withColumn("_w", _words(text)).withColumn("_c", F.filter(F.split(F.substring(text, 1, RUN), ""), lambda c: c != ""))
    out = out.withColumn("kind", F.when(inner > 0, "word").otherwise("character")).withColumn("k", k)
    run = lambda parts, at, n: F.xxhash64(F.lit(n), *[F.get(parts, F.lit(at + j)) for j in range(n)])
    each = F.coalesce(*[F.when((F.col("kind") == kind) & (F.col("k") == n), run(parts, at, n)) for kind, parts, at in (("word", "_w", 1), ("character", "_c", 0)) for n in range(1, RUN + 1)])
    return out.withColumn("run", each).drop("_w", "_c")


def contained(texts: DataFrame, passages: DataFrame, key: str, passage_key: str, text: str = "text") -> DataFrame:
    """Rows (passage_key, key): each text that contains a passage, once.

    A filter of FILTER words, in which every passage's run sets one bit, goes to all tasks: runs of a text that are not in
    it are dropped inside its row. Of the others, texts and passages meet by hash, and the texts that remain are
    searched. Empty passages stand in no text.
    """
    wanted = _keyed(passages.where(F.col(text) != "").select(passage_key, F.col(text).alias("passage")), "passage")
    kinds = sorted((r.kind, r.k) for r in wanted.select("kind", "k").distinct().collect())  # at most two for each length of a run
    word, bit = F.pmod(F.col("run"), F.lit(FILTER)).cast("int"), F.pmod(F.shiftright("run", 20), F.lit(64)).cast("int")
    bits = wanted.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    found = F.map_from_entries(F.collect_list(F.struct("word", "bits")))  # at most FILTER entries
    sieve = bits.agg(found.alias("m")).select(F.transform(F.sequence(F.lit(0), F.lit(FILTER - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("sieve"))
    rows = texts.select(key, text).withColumn("_w", _words(text))
    rows = rows.withColumn("_c", F.filter(F.split(text, ""), lambda c: c != "")) if any(kind == "character" for kind, _ in kinds) else rows
    rows = rows.join(F.broadcast(sieve))  # one row
    hit = lambda h: F.getbit(F.get("sieve", F.pmod(h, F.lit(FILTER)).cast("int")), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int")) == 1
    runs = [F.array_distinct(F.filter(_runs("_w" if kind == "word" else "_c", k), hit)) for kind, k in kinds]
    near = rows.withColumn("run", F.explode(F.array_distinct(F.concat(*runs)) if runs else F.array().cast("array<bigint>")))
    met = near.select(key, text, "run").join(wanted.select(passage_key, "passage", "run"), "run")
    return met.where(F.contains(F.col(text), F.col("passage"))).select(passage_key, key).distinct()
