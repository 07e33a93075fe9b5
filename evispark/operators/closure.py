"""A closure that is kept and brought up to date: what edges come and go changes, not the whole.

The closure of edges (src, dst) has a pair (node, ancestor) for every node and everything else that edges lead to from
it. Of edges that go, all pairs that some path over them gave are taken back at first; those that the remaining edges
still give are derived again, in rounds that look at the newest pairs alone. Edges that come add the pairs that lead to
them, over them, and on; a path over several of them is found in as many rounds.

Pairs are stored of inner nodes alone, those that some edge has led to. A node that none has led to stands on nobody
else's path; its pairs are its edges' ends with their pairs, which are joined when they are read. Edges of such nodes are
kept apart (outer; within are the others) and move when an edge first leads to the node. The stored form is a log of pairs
and edges that came and went, one part for each update, which is merged when it is read and rewritten once it has MOST parts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import cut
from ..sources.commits import Commits
from .graph import ancestors, few

MOST = 8
PAIR = ["node", "ancestor"]
EDGE = ["src", "dst"]


def _over(before: DataFrame, edges: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs whose path leads along ``before`` (pairs; or begins at the edge), over one of ``edges``, and along ``after``."""
    left = edges.select(F.col("src").alias("node"), "dst")
    left = left.unionByName(before.join(few(edges), before["ancestor"] == edges["src"]).select("node", "dst"))
    return _on(cut(left.distinct()), after)


def _on(left: DataFrame, after: DataFrame) -> DataFrame:
    whole = left.select("node", F.col("dst").alias("ancestor"))
    # pairs of many nodes lead to few ends: what follows is looked up, not dealt out by the end
    ends = cut(left.select("dst").distinct())
    on = few(cut(after.select(F.col("node").alias("dst"), "ancestor").join(few(ends), "dst", "left_semi")))
    further = left.join(on, "dst").select(*PAIR)
    return whole.unionByName(further).where("node <> ancestor").distinct()


def updated(pairs: DataFrame, edges: DataFrame, inserted: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What becomes of the closure ``pairs`` of ``edges``: pairs to be removed, then pairs to be added.

    Edges (src, dst) that are inserted and deleted at once stay as they are, as do deleted ones that are not there and
    inserted ones that are.
    """
    edges = edges.select("src", "dst").distinct()
    come, gone = inserted.select("src", "dst").distinct(), deleted.select("src", "dst").distinct()
    lost = cut(gone.join(come, ["src", "dst"], "left_anti").join(edges, ["src", "dst"], "left_semi"))
    new = cut(come.join(gone, ["src", "dst"], "left_anti").join(edges, ["src", "dst"], "left_anti"))
    removed = cut(_over(pairs, lost, pairs)) if not lost.isEmpty() else pairs.limit(0)
    kept = pairs
    if not removed.isEmpty():
        left = edges.join(few(lost), ["src", "dst"], "left_anti")
        kept = cut(pairs.join(removed, PAIR, "left_anti"))
        # one step over a remaining edge, then along a pair that is certain; afterwards along what has just become certain
        step = cut(removed.join(left.select(F.col("src").alias("node"), F.col("dst").alias("via")), "node"))
        direct = step.where("via = ancestor").select(*PAIR)
        along = lambda certain: step.join(certain.select(F.col("node").alias("via"), "ancestor"), ["via", "ancestor"], "left_semi").select(*PAIR)
        again = newest = cut(direct.unionByName(along(kept)).distinct())
        while not newest.isEmpty():
            newest = cut(along(newest).join(again, PAIR, "left_anti").distinct())
            again = again.unionByName(newest)
        removed = cut(removed.join(again, PAIR, "left_anti"))
        kept = kept.unionByName(again)
    if new.isEmpty():
        return removed, pairs.limit(0)
    added = newest = cut(_over(kept, new, kept).join(kept, PAIR, "left_anti"))
    while not newest.isEmpty():
        # a path over one more new edge: behind the last one, only old pairs
        left = cut(newest.join(few(new), newest["ancestor"] == new["src"]).select("node", "dst").distinct())
        if left.isEmpty():
            break
        newest = cut(_on(left, kept).join(kept, PAIR, "left_anti").join(added, PAIR, "left_anti"))
        added = added.unionByName(newest)
    return removed, added


class StoredClosure:
    """Edges and closure in a folder.

    Defined cases: an empty folder has neither; loops and repeated edges are the same as none and one; two writers that
    start from one state: the second is refused with CONFLICT.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.commits = spark, Commits(spark, folder)

    def _read(self, what: str, columns: list[str], only: DataFrame | None = None) -> DataFrame:
        """What is there of a log; with ``only``, of rows that agree with its columns."""
        parts = self.commits.latest()[1].get("parts", [])
        kinds = ", ".join(f"{c} string" for c in columns)
        if not parts:
            return self.spark.createDataFrame([], kinds)
        rows = self.spark.read.schema(f"{kinds}, there boolean, at bigint").parquet(*[f"{self.commits.folder}/{p}/{what}" for p in parts])
        if only is not None:
            rows = rows.join(few(only), only.columns, "left_semi")
        if len(parts) > 1:  # of one part, every row counts
            rows = rows.groupBy(*columns).agg(F.max_by("there", "at").alias("there"))
        return rows.where("there").select(*columns)

    def _inner(self) -> DataFrame:
        """Inner nodes; each stands in one part."""
        parts = self.commits.latest()[1].get("parts", [])
        if not parts:
            return self.spark.createDataFrame([], "node string")
        return self.spark.read.schema("node string").parquet(*[f"{self.commits.folder}/{p}/inner" for p in parts])

    def edges(self) -> DataFrame:
        return self._read("outer", EDGE).unionByName(self._read("within", EDGE))

    def pairs(self) -> DataFrame:
        inner, outer = self._read("pairs", PAIR), self._read("outer", EDGE)
        # an outer node's edges all end at inner ones
        ends = inner.unionByName(self._inner().select("node", F.col("node").alias("ancestor"))).withColumnRenamed("node", "dst")
        along = lambda some: some.join(ends, "dst").select(F.col("src").alias("node"), "ancestor")
        # only of several edges can two give the same pair
        several = cut(outer.groupBy("src").count().where("count > 1").select("src"))
        if several.isEmpty():
            return inner.unionByName(along(outer))
        several = few(several)
        return inner.unionByName(along(outer.join(several, "src", "left_anti"))).unionByName(along(outer.join(several, "src", "left_semi")).distinct())

    def _write(self, part: str, what: str, at: int, there: DataFrame, gone: DataFrame) -> None:
        rows = there.withColumn("there", F.lit(True)).unionByName(gone.select(*there.columns).withColumn("there", F.lit(False)))
        rows.withColumn("at", F.lit(at).cast("long")).write.parquet(f"{self.commits.folder}/{part}/{what}")

    def update(self, inserted: DataFrame, deleted: DataFrame) -> None:
        number, body = self.commits.latest()
        parts = body.get("parts", [])
        some = lambda df: df.where("src <> dst").select("src", "dst").distinct()
        come, gone = some(inserted), some(deleted)
        come, gone = cut(come.join(gone, EDGE, "left_anti")), cut(gone.join(come, EDGE, "left_anti"))
        inner = self._inner()
        fresh = cut(come.select(F.col("dst").alias("node")).distinct().join(inner, "node", "left_anti"))
        # edges of nodes that become inner move
        moved = self._read("outer", EDGE, fresh.withColumnRenamed("node", "src"))
        known = inner.unionByName(fresh).withColumnRenamed("node", "src").withColumn("known", F.lit(True))
        told = lambda df: cut(df.join(known, "src", "left"))
        come, gone, moved = told(come), told(gone), cut(moved)
        plus = come.where("known").select(*EDGE).unionByName(moved.join(gone, EDGE, "left_anti"))
        minus = gone.where("known").select(*EDGE)
        if parts:
            removed, added = updated(self._read("pairs", PAIR), self._read("within", EDGE), plus, minus)
        else:
            added = ancestors(plus)
            removed = added.limit(0)
        part = f"part-{uuid.uuid4().hex}"
        # a pair that went and came again stands twice; what came counts
        removed = removed.join(added, PAIR, "left_anti")
        self._write(part, "pairs", number + 1, added, removed)
        self._write(part, "within", number + 1, plus, minus)
        self._write(part, "outer", number + 1, come.where("known is null").select(*EDGE), gone.where("known is null").select(*EDGE).unionByName(moved))
        fresh.write.parquet(f"{self.commits.folder}/{part}/inner")
        try:
            self.commits.create(number, {"parts": [*parts, part]})
        except Exception:
            self.commits.delete(part)
            raise
        if len(parts) + 1 > MOST:
            self._compact()

    def _compact(self) -> None:
        number, body = self.commits.latest()
        part = f"part-{uuid.uuid4().hex}"
        edges = cut(self.edges())
        # nodes that no edge leads to any more are outer again
        inner = cut(edges.select(F.col("dst").alias("node")).distinct())
        ends = inner.withColumnRenamed("node", "src")
        pairs = self._read("pairs", PAIR).join(inner, "node", "left_semi")
        for what, rows in (("pairs", pairs), ("within", edges.join(ends, "src", "left_semi")), ("outer", edges.join(ends, "src", "left_anti"))):
            self._write(part, what, number, rows, rows.limit(0))
        inner.write.parquet(f"{self.commits.folder}/{part}/inner")
        self.commits.create(number, {"parts": [part]})
        for old in body["parts"]:  # of readers of the commit before, those that have not begun to read start again
            self.commits.delete(old)
