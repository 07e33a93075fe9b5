"""Names and what they mean: declarations looked up, occurrences resolved, records and evidence put together.

Nothing here joins on a bare name. A name only means a declaration within a file: one of the file's own, or one that
the file imports from another. Equal names elsewhere stay unrelated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of declarations that can run.
EXECUTABLE = ("FunctionDeclaration", "MethodDeclaration", "Constructor", "GetAccessor", "SetAccessor", "ArrowFunction", "FunctionExpression")
HOLDERS = ("VariableDeclaration", "PropertyDeclaration")


def records(symbols: DataFrame, outline: DataFrame, by: list[str], position: str = "position", signature: str = "signature", text: str = "text") -> DataFrame:
    """Symbols with the signature that the outline has for them (of several, the last one), else their own text."""
    last = outline.groupBy(*by).agg(F.max_by(signature, position).alias("_signature"))
    return symbols.join(last, by, "left").withColumn(signature, F.coalesce("_signature", text)).drop("_signature")


def executable(kind: str = "kind", signature: str = "signature") -> Column:
    """Whether a declaration has a body that runs: a function of some kind, or a variable or property that holds one."""
    holds = F.col(signature).rlike(r"=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)")
    return F.col(kind).isin(*EXECUTABLE) | (F.col(kind).isin(*HOLDERS) & holds)


def lookup(symbols: DataFrame, wanted: DataFrame, file: str = "file_path", symbol: str = "symbol", body: str = "has_body") -> DataFrame:
    """For each wanted (file, symbol): how many declarations it names, and the selector of the one that is meant.

    A selector means itself. A path means its only declaration, or of several the only one with a body.
    """
    exact = wanted.join(symbols.select(file, F.col("selector").alias(symbol), F.col("selector").alias("own"), F.lit(True).alias("exact"), body), [file, symbol])
    path = wanted.join(symbols.select(file, F.col("symbol_path").alias(symbol), F.col("selector").alias("own"), F.lit(False).alias("exact"), body), [file, symbol])
    found = exact.unionByName(path).distinct()
    counts = found.groupBy(file, symbol).agg(F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_path"), F.count_if(~F.col("exact") & F.col(body)).alias("n_bodies"), F.min(F.when(F.col("exact"), F.col("own"))).alias("by_selector"), F.min(F.when(~F.col("exact"), F.col("own"))).alias("by_path"), F.min(F.when(~F.col("exact") & F.col(body), F.col("own"))).alias("by_body"))
    meant = F.when(F.col("n_exact") > 0, F.col("by_selector")).when(F.col("n_path") == 1, F.col("by_path")).when(F.col("n_bodies") == 1, F.col("by_body"))
    out = wanted.join(counts.select(file, symbol, F.greatest("n_exact", "n_path").alias("n_found"), meant.alias("resolved")), [file, symbol], "left")
    return out.select(file, symbol, F.coalesce("n_found", F.lit(0)).alias("n_found"), "resolved")


def scope(declarations: DataFrame, imports: DataFrame) -> DataFrame:
    """Rows (file, name, symbol_id): what a name means in a file, where it means one thing: a declaration (file, name,
    symbol_id) of its own, else one that an import (file, name, target) brings in."""
    own = declarations.groupBy("file", "name").agg(F.min("symbol_id").alias("symbol_id"), F.count_distinct("symbol_id").alias("n"))
    brought = imports.join(declarations.withColumnRenamed("file", "target"), ["target", "name"]).groupBy("file", "name").agg(F.min("symbol_id").alias("symbol_id"), F.count_distinct("symbol_id").alias("n"))
    rest = brought.join(own.select("file", "name"), ["file", "name"], "left_anti")
    return own.unionByName(rest).where("n = 1").drop("n")


def resolved(occurrences: DataFrame, declarations: DataFrame, imports: DataFrame) -> DataFrame:
    """Occurrences (file, name, ...) with the symbol_id that they mean, null where that is not known."""
    return occurrences.join(scope(declarations, imports), ["file", "name"], "left")


def attached(clusters: DataFrame, evidence: DataFrame, file: str = "file", selector: str = "selector") -> DataFrame:
    """Clusters with their evidence, by file and selector: equal selectors of two files share nothing."""
    return clusters.join(evidence, [file, selector], "left")
