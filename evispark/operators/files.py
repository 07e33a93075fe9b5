"""Files and lines: listing, slices, path resolution, digests, snapshot differences, index refresh plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import FILES_MAX, PAGE_MAX, ROW_BYTES_MAX, ROWS_BYTES_MAX, SYMBOLS_MAX, QueryError, page_bounds
from ..functions.scalar import by_language, has
from ..plans.checkpoints import cut
from .search import page


def scan(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Every file below ``root`` that fits ``pattern``: path relative to it, content, size and modification time."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:(//)?", "")
    return found.select(F.substring(path, len(base) + 2, 1 << 20).alias("path"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))


def list_files(files: DataFrame, filter_text: str | None = None, offset: int = 0, limit: int = 100, path: str = "path", language_order: bool = True) -> DataFrame:
    out = files.where(has(F.col(path), filter_text)) if filter_text else files
    return page(out, [by_language(path) if language_order else F.col(path), F.col(path)], offset, limit)


def line_array(text: Column) -> Column:
    """Lines ended by CRLF, LF or CR; a last end starts no further line and an empty text has none."""
    parts = F.split(text, "\r\n|\n|\r", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows (key, line, text), lines counted from 1."""
    return files.select(key, F.posexplode(line_array(F.col(text))).alias("at", "line_text")).select(key, (F.col("at") + 1).alias("line"), "line_text")


def line_slice(files: DataFrame, key: str, offset: int = 0, limit: int = PAGE_MAX, text: str = "text") -> DataFrame:
    """Lines ``offset + 1`` to ``offset + limit`` of each file, with its number of lines. Only the slice is exploded."""
    page_bounds(offset, limit)
    cut = files.select(key, line_array(F.col(text)).alias("all"))
    part = F.slice("all", offset + 1, limit)
    return cut.select(key, F.size("all").cast("long").alias("total_lines"), F.posexplode(part).alias("at", "line_text")).select(key, (F.col("at") + offset + 1).alias("line"), "line_text", "total_lines")


def line_counts(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    return files.select(key, F.size(line_array(F.col(text))).cast("long").alias("n_lines"))


def resolve(files: DataFrame, wanted: str, path: str = "path") -> str:
    """The path itself, else the only one that ends with it after a slash; refuses with the sorted choices if there are several."""
    ends = files.where((F.col(path) == wanted) | F.endswith(F.col(path), F.lit("/" + wanted))).select(path).distinct()
    found = sorted(r[0] for r in ends.orderBy(F.col(path) != wanted, path).limit(PAGE_MAX).collect())
    if wanted in found:
        return wanted
    if len(found) != 1:
        raise QueryError("AMBIGUOUS_TARGET" if found else "NOT_FOUND", f"{wanted!r} names {len(found)} files", found)
    return found[0]


def suffix_matches(files: DataFrame, wanted: DataFrame, path: str, suffix: str) -> DataFrame:
    """For each wanted suffix: the number of files, and the file if it is the only one.

    Each path is joined by all its own suffixes, whose number is its depth, so that no pair is tried in vain.
    """
    depth = F.split(F.col(path), "/")
    tails = files.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.size(depth)), lambda i: F.array_join(F.slice(depth, i, F.size(depth)), "/"))).alias("tail"))
    got = wanted.join(tails, wanted[suffix] == tails["tail"], "left")
    return got.groupBy(suffix).agg(F.countDistinct(path).alias("n_files"), F.when(F.countDistinct(path) == 1, F.min(path)).alias("resolved"))


def closure(links: DataFrame, start: DataFrame, source: str, target: str) -> DataFrame:
    """Everything reachable from ``start`` (one column, node), itself included; cycles end the search."""
    from .graph import reach

    edges = links.select(F.col(source).alias("src"), F.col(target).alias("dst"))
    return reach(edges, start, None).select("node")


def fingerprints(files: DataFrame, path: str, content: str) -> DataFrame:
    return files.select(path, F.octet_length(content).cast("long").alias("size_bytes"), F.sha2(F.col(content).cast("binary"), 256).alias("content_hash"))


def digest(rows: DataFrame, path: Column, content_hash: Column, by: list[str] | None = None) -> DataFrame:
    """SHA-256 over ``path NUL hash NUL`` of all files in order of path, for each group of ``by``.

    A digest is one text by definition, so a group's paths and hashes meet in one place; its size is that of the listing.
    """
    pair = F.struct(path.alias("p"), content_hash.alias("h"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.concat(x["p"], F.lit("\0"), x["h"], F.lit("\0"))), "")
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n_files"), F.sha2(text.cast("binary"), 256).alias("digest"))


def snapshot_diff(before: DataFrame, after: DataFrame, path: str = "path", content_hash: str = "content_hash") -> DataFrame:
    """Rows (path, change): added, deleted, changed or unchanged."""
    a, b = before.select(path, F.col(content_hash).alias("_old")), after.select(path, F.col(content_hash).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "changed").otherwise("unchanged")
    return a.join(b, path, "full").select(path, change.alias("change"))


def refresh_plan(current: DataFrame, existing: DataFrame, config_digest: str | None = None, path: str = "file_path") -> DataFrame:
    """Rows (path, action): rebuild what is new or differs in content or configuration, reuse the rest, remove what is gone.

    ``current`` has content_hash, ``existing`` content_hash and config_digest. One stored row of another configuration
    rebuilds every file.
    """
    old = existing.select(path, F.col("content_hash").alias("_old"), F.col("config_digest").alias("_config"))
    both = current.select(path, F.col("content_hash").alias("_new")).join(old, path, "full")
    if config_digest is not None:
        other = existing.where(~F.col("config_digest").eqNullSafe(F.lit(config_digest))).limit(1).agg((F.count("*") > 0).alias("_all"))
        both = both.join(F.broadcast(other))  # one row
    else:
        both = both.withColumn("_all", F.lit(False))
    action = F.when(F.col("_new").isNull(), "remove").when(F.col("_all") | F.col("_old").isNull() | (F.col("_old") != F.col("_new")), "rebuild").otherwise("reuse")
    return both.select(path, action.alias("action"))


def rescan(index: DataFrame, files: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str = "path", content: str = "text", verify: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The index (path, content_hash, ...) brought up to date with ``files``: unchanged rows stay, new and changed files are
    extracted again, deleted ones go. ``extract`` adds its columns to the files it is given, and no others are read through it.

    ``verify`` lists the files once more at the end; if they are no longer the same, nothing is answered.
    """
    now = files.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256))
    plan = snapshot_diff(index, now.select(path, "content_hash"), path).where(F.col("change") != "deleted")
    again = extract(now.join(plan.where(F.col("change").isin("added", "changed")).select(path), path, "left_semi"))
    kept = index.join(plan.where(F.col("change") == "unchanged").select(path), path, "left_semi")
    out = kept.withColumn("reused", F.lit(True)).unionByName(again.select(*index.columns).withColumn("reused", F.lit(False)))
    if verify is not None:
        out = cut(out)
        later = verify().select(path, F.sha2(F.col(content).cast("binary"), 256).alias("content_hash"))
        if not snapshot_diff(out, later, path).where(F.col("change") != "unchanged").isEmpty():
            raise QueryError("CONFLICT", "files changed while they were scanned")
    return out


def checked_refresh(current: DataFrame, existing: DataFrame, rebuilt: DataFrame, config_digest: str, path: str = "file_path") -> DataFrame:
    """The plan, once what was supplied for rebuilding fits it; supplied files count as rebuilt even if unchanged."""
    problems = {
        "more than the most files": current.limit(FILES_MAX + 1).count() > FILES_MAX,
        "a current path repeats": _repeats(current, path),
        "a rebuilt path repeats": _repeats(rebuilt, path),
        "a rebuilt file is not current": not rebuilt.join(current, path, "left_anti").isEmpty(),
        "a rebuilt hash is not the current one": not rebuilt.select(path, F.col("content_hash").alias("_h")).join(current, path).where("_h <> content_hash").isEmpty(),
    }
    plan = refresh_plan(current, existing, config_digest, path)
    problems["a file needs a projection and has none"] = not plan.where("action = 'rebuild'").join(rebuilt, path, "left_anti").isEmpty()
    if found := [p for p, there in problems.items() if there]:
        raise QueryError("INVALID_INPUT", "; ".join(found))
    return plan.join(rebuilt.select(path, F.lit(True).alias("_r")), path, "left").select(path, F.when(F.col("_r"), "rebuild").otherwise(F.col("action")).alias("action"))


def _repeats(rows: DataFrame, key: str) -> bool:
    return not rows.groupBy(key).count().where("count > 1").isEmpty()


def within_budget(rows: DataFrame, size: Column, symbols: Column) -> DataFrame:
    """One row: totals, and whether they stay within the limits of a stored index."""
    out = rows.agg(F.count("*").alias("n_files"), F.sum(size).cast("long").alias("bytes"), F.max(size).cast("long").alias("largest"), F.sum(symbols).cast("long").alias("n_symbols"))
    fits = (F.col("n_files") <= FILES_MAX) & (F.col("bytes") <= ROWS_BYTES_MAX) & (F.col("largest") <= ROW_BYTES_MAX) & (F.col("n_symbols") <= SYMBOLS_MAX)
    return out.withColumn("fits", F.coalesce(fits, F.lit(True)))
