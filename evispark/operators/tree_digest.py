"""A digest of a set of files that combines partially and is brought up to date by changed paths alone.

Files are dealt to the leaves of a tree of 16 children a node by the first LEVELS hexadecimal digits of the hash of their
path. A leaf's sum adds up, lane by lane of 32 bits, the hashes of its files' (path, content hash), so that sums of parts
add up to the sum of the whole in any order, and a file is taken out as it was put in; its digest is the hash of number
and sum. A node's digest is the hash of its children's digests in order. The root's digest stands for the set; of two
trees, equal nodes hold equal files, so that differences are found along unequal ones. Sums are no defence against
somebody who chooses contents in order to collide; the listing's own digest (``files.digest``) is.

Defined cases: no files give no leaf and a root of 16 missing children; a path that repeats counts as often as it is
there; a null content hash is as an empty one; a changed path that the tree does not hold makes a wrong tree, as does
an old hash that was not the one held: both show in the root's digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import cut

VERSION, LEVELS, LANES = 1, 4, 8
MODULUS = 1 << 32
MISSING = "-"
DIGITS = "0123456789abcdef"


def _lane(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _leaf(n: Column, lanes: list[Column]) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(f"v{VERSION}"), n.cast("string"), *[x.cast("string") for x in lanes]).cast("binary"), 256)


def _sums(rows: DataFrame, path: Column, content_hash: Column, sign: int, levels: int) -> DataFrame:
    own = F.sha2(F.concat_ws("\0", path.cast("string"), F.coalesce(content_hash, F.lit(""))).cast("binary"), 256)
    at = F.substring(F.sha2(path.cast("string").cast("binary"), 256), 1, levels)
    rows = rows.select(at.alias("prefix"), own.alias("own"))
    lanes = [(F.sum(_lane(F.col("own"), i)) * sign).alias(f"s{i}") for i in range(LANES)]
    return rows.groupBy("prefix").agg((F.count("*") * sign).alias("n"), *lanes)


def leaves(files: DataFrame, path: Column, content_hash: Column, levels: int = LEVELS) -> DataFrame:
    """(prefix, n, s0..s7, digest) of each leaf with files."""
    return _closed(_sums(files, path, content_hash, 1, levels))


def _closed(sums: DataFrame) -> DataFrame:
    lanes = [F.pmod(F.col(f"s{i}"), F.lit(MODULUS)).alias(f"s{i}") for i in range(LANES)]
    out = sums.select("prefix", "n", *lanes).where("n <> 0")
    return out.withColumn("digest", _leaf(F.col("n"), [F.col(f"s{i}") for i in range(LANES)]))


def _parents(children: DataFrame) -> DataFrame:
    """(prefix, n, digest) of the nodes above (prefix, n, digest); of a node, all children must be there."""
    last = F.substring("prefix", -1, 1)
    each = [F.coalesce(F.max(F.when(last == d, F.col("digest"))), F.lit(MISSING)) for d in DIGITS]
    up = children.withColumn("up", F.expr("substring(prefix, 1, length(prefix) - 1)"))
    return up.groupBy("up").agg(F.sum("n").alias("n"), F.sha2(F.concat(*each).cast("binary"), 256).alias("digest")).select(F.col("up").alias("prefix"), "n", "digest")


def _empty_root() -> Column:
    return F.sha2(F.lit(MISSING * 16).cast("binary"), 256)


def tree(files: DataFrame, path: Column, content_hash: Column, levels: int = LEVELS) -> DataFrame:
    """All nodes (prefix, n, digest, s0..s7; sums null above the leaves); the root's prefix is empty."""
    return _above(leaves(files, path, content_hash, levels), levels)


def _above(level: DataFrame, levels: int) -> DataFrame:
    none = [F.lit(None).cast("long").alias(f"s{i}") for i in range(LANES)]
    # no level is larger than the one below it; each is written once
    out = level = cut(level)
    nodes = level.select("prefix", "n", "digest")
    for _ in range(levels):
        nodes = cut(_parents(nodes))
        out = out.unionByName(nodes.select("*", *none))
    return out


def updated(nodes: DataFrame, removed: DataFrame, added: DataFrame, path: str = "path", content_hash: str = "content_hash", levels: int = LEVELS) -> DataFrame:
    """The nodes of ``nodes`` (a written table) that change when files go and come (a changed file does both), with their new digests; nodes
    that lose their last file have n = 0 and a null digest. For each changed path that is one node a level."""
    change = _sums(removed, F.col(path), F.col(content_hash), -1, levels).unionByName(_sums(added, F.col(path), F.col(content_hash), 1, levels))
    change = change.groupBy("prefix").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(LANES)])
    touched = change.select("prefix")
    sums = nodes.where(F.length("prefix") == levels).join(touched, "prefix", "left_semi").select("prefix", "n", *[f"s{i}" for i in range(LANES)]).unionByName(change)
    sums = sums.groupBy("prefix").agg(F.sum("n").alias("n"), *[F.pmod(F.sum(f"s{i}"), F.lit(MODULUS)).alias(f"s{i}") for i in range(LANES)])
    level = cut(sums.withColumn("digest", F.when(F.col("n") != 0, _leaf(F.col("n"), [F.col(f"s{i}") for i in range(LANES)]))))
    none = [F.lit(None).cast("long").alias(f"s{i}") for i in range(LANES)]
    out, fresh = level, level.select("prefix", "n", "digest")
    for depth in range(levels, 0, -1):
        up = F.substring("prefix", 1, depth - 1)
        parents = fresh.select(up.alias("up")).distinct()
        # the children of the nodes above: those that are new, and those that stay as they are
        old = nodes.where(F.length("prefix") == depth).select("prefix", "n", "digest").withColumn("up", up).join(parents, "up", "left_semi").join(fresh.select("prefix"), "prefix", "left_anti")
        both = old.select("prefix", "n", "digest").unionByName(fresh)
        fresh = _parents(both)
        if depth > 1:
            fresh = fresh.withColumn("digest", F.when(F.col("n") != 0, F.col("digest")))
        fresh = cut(fresh)
        out = out.unionByName(fresh.select("*", *none))
    return out


def replaced(nodes: DataFrame, fresh: DataFrame) -> DataFrame:
    """``nodes`` with those of an update in the place of their old form."""
    return nodes.join(fresh.select("prefix"), "prefix", "left_anti").unionByName(fresh.select(*nodes.columns)).where("n <> 0 or prefix = ''")


def root(nodes: DataFrame) -> str:
    """The digest of all files."""
    found = nodes.where("prefix = ''").select("digest").first()
    return found[0] if found else nodes.sparkSession.range(1).select(_empty_root()).first()[0]
