"""Change feeds: bursts of changed paths settle into batches; too many paths at once fail closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Paths that may be pending, and directory names that are never watched.
PENDING_MAX, DIRECTORIES_MAX = 65, 512
UNWATCHED = (".git", ".yarn", "coverage", "dist", "node_modules")


def debounced(changes: DataFrame, key: str, gap: str, most: int = PENDING_MAX, time: str = "ts", path: str = "path") -> DataFrame:
    """Batches of changes, each ended by a pause of ``gap``: the different paths, and whether there were more than ``most``.

    Works on tables and on streams (with a watermark on ``time``).
    """
    # a burst's different paths are held in one set, however often each has changed
    w = F.session_window(time, gap)
    out = changes.groupBy(key, w).agg(F.count("*").alias("n_events"), F.collect_set(path).alias("paths"))
    n = F.size("paths").cast("long")
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events", n.alias("n_paths"), (n > most).alias("overflow"), F.when(n > most, F.lit(None)).otherwise(F.array_sort("paths")).alias("paths"))


def stream(changes: DataFrame, key: str, gap: str, lateness: str = "1 minute", most: int = PENDING_MAX) -> DataFrame:
    """The same over a stream of (key, ts, path)."""
    return debounced(changes.withWatermark("ts", lateness), key, gap, most)


def watched(paths: DataFrame, path: str = "path") -> DataFrame:
    """Directories above source files, shallow ones first, without those that are never watched."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    out = paths.select(F.explode(prefixes).alias("directory")).distinct()
    bad = F.exists(F.split("directory", "/"), lambda s: s.isin(list(UNWATCHED)))
    depth = F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/")))
    return out.where(~bad).orderBy(depth, F.collate("directory", "UNICODE"))
